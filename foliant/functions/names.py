"""Column functions over file names: part tokens, split volumes, lint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths
from .sniff import first_of

# Tokens that say nothing about which map a name means, and suffixes of resized copies.
NOISE = ("combined", "variations", "gridless", "gridded", "grid", "hd", "a2", "pta", "ptb", "online")
BOOKS = (".pdf", ".epub", ".mobi", ".azw", ".azw3", ".djvu", ".txt")
BAD_RESIZE = ("_4k", "_2k", "_1k", "_max8000", "_proxy", "_resized")
# Fixed values: (scheme, pattern, base suffix) of split volumes, in order of precedence, and temporary names.
VOLUMES = (
    ("rar_part", r"(?i)^(.+)\.part(\d+)(\.rar)$"),
    ("zip_z", r"(?i)^(.+)\.z(\d{2})$"),
    ("numeric", r"(?i)^(.+)\.(\d{3})$"),
    ("named_part", r"(?i)^(.*?)\s*\(\s*part\s+(\d+)\s*\)\s*(\.[^.]+)$"),
    ("named_part", r"(?i)^(.*?)_pt(\d+)\s*(\.[^.]+)$"),
    ("named_part", r"(?i)^(.*?)\s+part\s+(\d+)\s*(\.[^.]+)$"),
)
TEMPORARY = (r"(?i)^(.+)\.partial$", r"(?i)^(.+\.[^.]+)\.part\d+$", r"(?i)^(.+)\.bad\d*$")


def part_tokens(stem: Column) -> Column:
    """Lower-case tokens between underscores, without apostrophes, white space and noise; repeats stay."""
    plain = F.regexp_replace(F.lower(stem), "['’‘]|\\s", "")
    return F.filter(F.split(plain, "_+"), lambda t: (t != "") & ~t.isin(*NOISE))


def marker(token: Column) -> Column:
    """The letter or digits that number a part: one letter or digit, or ``pt`` and digits; else null."""
    return F.when(token.rlike(r"^[\p{L}\p{N}]$"), token).when(token.rlike(r"^pt\d+$"), F.substring(token, 3, 99))


def contiguous_run(markers: Column) -> Column:
    """Whether two or more distinct markers are a, b, c... or 1, 2, 3... without a gap."""
    kinds = F.array_distinct(markers)
    n = F.size(kinds)
    letters = F.forall(kinds, lambda m: m.rlike("^[a-z]$"))
    digits = F.forall(kinds, lambda m: m.rlike(r"^\d+$"))
    codes = F.transform(kinds, lambda m: F.when(letters, F.ascii(m) - 96).otherwise(F.expr("NULL").cast("int")))
    numbers = F.transform(kinds, lambda m: m.try_cast("int"))
    run = lambda a: F.coalesce((F.array_min(a) == 1) & (F.array_max(a) == n) & (F.size(F.array_distinct(a)) == n), F.lit(False))
    return (n >= 2) & F.when(letters, run(codes)).when(digits, run(numbers)).otherwise(F.lit(False))


def marker_text(markers: Column) -> Column:
    """Distinct markers in order, in numbers' order if all are numbers; ``-`` without any."""
    kinds = F.array_distinct(markers)
    digits = F.forall(kinds, lambda m: m.rlike(r"^\d+$"))
    numbers = F.array_join(F.transform(F.array_sort(F.transform(kinds, lambda m: m.try_cast("int"))), lambda n: n.cast("string")), "")
    return F.when(F.size(kinds) == 0, "-").when(digits, numbers).otherwise(F.array_join(F.array_sort(kinds), ""))


def parts_found(markers: Column, area: Column) -> Column:
    return F.when(F.size(markers) == 0, "no").when((area >= 80) | contiguous_run(markers), "yes").otherwise("partial")


def temporary_target(name: Column) -> Column:
    """The final name behind a temporary one; null for other names."""
    return first_of([(name.rlike(p), F.regexp_extract(name, p, 1)) for p in TEMPORARY])


def split_volume(name: Column) -> Column:
    """struct<scheme, base, index, concat> of one volume of a split file; null for other names."""
    cases = [(temporary_target(name).isNotNull(), F.lit(None))]
    for scheme, pattern in VOLUMES:
        stem = F.regexp_extract(name, pattern, 1)
        base = {"zip_z": lambda s: F.concat(s, F.lit(".zip")), "numeric": lambda s: s}.get(scheme, lambda s, p=pattern: F.concat(F.rtrim(s), F.regexp_extract(name, p, 3)))(stem)
        made = F.struct(F.lit(scheme).alias("scheme"), base.alias("base"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("index"), F.lit(scheme == "numeric").alias("concat"))
        cases.append((name.rlike(pattern), made))
    return first_of(cases)


def lint(path: Column, kind: Column) -> Column:
    """Codes of everything wrong with a relative path's names, in order: each component's, then the file name's for its kind."""
    parts = F.split(path, "/")
    component = F.flatten(
        F.transform(
            parts,
            lambda p: F.array_compact(
                F.array(
                    F.when(F.instr(p, " ") > 0, "spaces"),
                    F.when(p.rlike(paths.ILLEGAL), "illegal"),
                    F.when(p.rlike("[ .]$"), "trailing"),
                    F.when(F.upper(paths.stem(p)).isin(*paths.RESERVED) | F.upper(p).isin(*paths.RESERVED), "reserved"),
                )
            ),
        )
    )
    name = F.element_at(parts, -1)
    pieces = F.split(paths.stem(name), "_")
    full = ~F.exists(pieces, lambda p: p == "")
    ext = F.lower(paths.suffix(name))
    book = (ext == ".pdf") & full & (F.size(pieces).isin(3, 4) | ((F.size(pieces) == 5) & (F.get(pieces, F.lit(1)) == "Fan")))
    fiction = ext.isin(*BOOKS) & paths.stem(name).rlike(r"^[^_]+_\d{4}_[^_]+(_[^_]+_\d+)?(_coauth_[^_]+)?$")
    review = paths.suffix(name).rlike(r"^\.[A-Za-z0-9]+$") & paths.stem(name).rlike(r"^not[A-Za-z0-9][^_]*(_[^_]+)+_\d{8}(_\d{4})?$")
    resized = F.lower(paths.stem(name)).rlike("(" + "|".join(BAD_RESIZE) + ")$")
    wrong = F.when((kind == "game-book") & ~book, "game-book").when((kind == "fiction") & ~fiction, "fiction").when((kind == "review") & ~review, "review").when(kind.isin("image", "map") & resized, "resized")
    return F.concat(component, F.array_compact(F.array(wrong)))
