"""Functions of one row on cases worked out by hand: every document takes the case of its id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, names, posts, records
from ..operators import parts
from . import views
from .registry import ORACLES, QUERIES


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def _lit(value, kind: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*map(F.lit, value)).cast(kind)
    return F.lit(value).cast(kind)


def _kind(values) -> str:
    seen = [v for v in values if v is not None]
    if not seen:
        return "string"
    if isinstance(seen[0], (list, tuple)):
        inner = [x for v in seen for x in v]
        return f"array<{_kind(inner)}>"
    return "double" if any(isinstance(v, float) for v in seen) else _KINDS[type(seen[0])]


def cases(name: str, function: Callable[..., Column], *rows: tuple) -> None:
    """Register ``function`` on rows of (inputs..., expected); the SQL has the expected values."""
    kinds = [_kind(column) for column in zip(*(r[:-1] for r in rows))]
    sql_kind = {"boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    want = _kind([r[-1] for r in rows])
    cast = sql_kind[want[6:-1]] + "[]" if want.startswith("array") else sql_kind[want]

    def run(spark, sf_dir):
        given = F.array(*[F.struct(*[_lit(v, k).alias(f"c{n}") for n, (v, k) in enumerate(zip(r[:-1], kinds))]) for r in rows])
        d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.element_at(given, (F.col("doc_id") % len(rows) + 1).cast("int")).alias("x"))
        return d.select("id", function(*[F.col(f"x.c{n}") for n in range(len(kinds))]).cast(want).alias("out"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id AS id, CAST(([{', '.join(_literal(r[-1]) for r in rows)}])[CAST(doc_id % {len(rows)} + 1 AS INT)] AS {cast}) AS out FROM documents"


cases("cookie_headers", lambda raw: posts.cookie_header(raw)["header"], ("abc", "session_id=abc"), ("'a=b; c=d'", "a=b; c=d"), ("Cookie: x=1", "x=1"), ("a\nb", None), ("  ", ""), (None, ""), ('"tok"', "session_id=tok"))
cases("display_sizes", records.display_bytes, (None, "—"), (12, "12 B"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"))
cases(
    "window_starts", lambda now, since, months: F.date_format(dates.window_start(now.cast("timestamp"), "America/New_York", since, months.cast("int")), "yyyy-MM-dd HH:mm"),
    ("2026-03-31 12:00:00", None, 1, "2026-02-28 00:00"), ("2026-03-31 12:00:00", "2025-01-05", 1, "2025-01-05 00:00"), ("2026-03-31 12:00:00", None, None, None), ("2026-01-01 03:00:00", None, 1, "2025-11-30 00:00"),
)
cases("window_ends", lambda now, until: F.date_format(dates.window_end(now.cast("timestamp"), "America/New_York", until), "yyyy-MM-dd HH:mm"), ("2026-03-31 12:00:00", None, "2026-04-01 00:00"), ("2026-01-01 03:00:00", None, "2026-01-01 00:00"), ("2026-03-31 12:00:00", "2025-07-01", "2025-07-01 00:00"))
cases(
    "part_evidence", lambda c, n, m, a, f: parts.evidence(c, n, m, a.cast("int"), f), (True, 2, "ab", 100, "yes", "name/folder says Combined; 2 part maps of same variant in set; rule=area>=80; letters=ab; area=100%"),
    (False, 0, "-", 0, "no", "no Combined in name; no lettered/pt part maps of this map in set; rule=no parts; letters=-; area=0%"), (True, 1, "f", 10, "partial", "name/folder says Combined; 1 part maps of same variant in set; rule=parts present, area under 80, run incomplete; letters=f; area=10%"),
)
cases("kind_lint", lambda p, k: F.concat_ws(",", names.lint(p, k)), ("note.txt", "generic", ""), ("Dnd_5e_Phandelver.pdf", "game-book", ""), ("a b?.pdf", "generic", "spaces,illegal"), ("x_4k.png", "map", "resized"), ("Tolkien_1954_Fellowship.pdf", "fiction", ""), ("CON.txt", "generic", "reserved"), ("bad.txt", "game-book", "game-book"))
