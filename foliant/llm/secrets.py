"""Secret scans: three fixed kinds, and a randomness battery for tokens of unknown kind.

Everything is built from column expressions.  A kind's matches come from ``regexp_extract_all`` and their
places from the gaps that ``split`` leaves between the same matches.

The battery looks at every token-like run that no fixed kind touches.  Its encoding is the smallest alphabet that
holds it (hex, base32, base36, base62, base64).  Against that alphabet three tests are made of whether the token
could be random: chi-squared uniformity of its letters, runs above and below the middle of the alphabet, and
lag-one serial correlation.  Fisher's method joins their p-values; what fails them is no random token.

What passes could still be an ordinary identifier, and that is the null hypothesis whose errors are controlled.
Identifiers are modelled letter by letter: how they go on from lower case, capitals, digits and separators, and
which letter follows which within the words of all texts.  A proper model gives a likelihood ratio against the
uniform one, and its inverse bounds the p-value of "this is an identifier" whatever the token's length.  In
each stratum of encoding, length and presence of digits tokens are reported by Benjamini and Hochberg's rule, so
that the expected share of identifiers among them stays within ``fdr``.  All candidates of all texts count.

Every step is linear in the number of matches, or nearly: arrays are filled in blocks.
"""

from __future__ import annotations

from math import log as _log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

# The kinds of the contract and their patterns, in order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: A maximal run of token letters, 20 or more, and padding; COVERED stands for what a fixed kind has taken (a text's own are put aside first).
COVERED = "\ufdd0"
CANDIDATE = r"(?<![A-Za-z0-9+/_\x{FDD0}-])[A-Za-z0-9+/_\x{FDD0}-]{20,}={0,2}"
#: Alphabets from the smallest on: name, pattern of tokens that fit, letters in order of their values.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/"),
)
#: Steps of the p-value histogram from which the thresholds are read: 40 for each power of ten.
STEPS, DECADES = 40, 30
#: Letters of a stratum's length band; tokens above the last band share it.
BAND, BANDS = 8, 16
#: A token whose battery gives less is no random one: a thousandth of all random tokens has less.
LEAST_P = 1e-3
#: How identifiers go on: rows from lower case, capital, digit, separator to the same; a token without lower case counts as written in it.
GOES_ON = ((0.88, 0.05, 0.03, 0.04), (0.50, 0.40, 0.05, 0.05), (0.12, 0.12, 0.56, 0.20), (0.50, 0.22, 0.22, 0.06))
#: Letters of words are counted in runs of so many; each pair counts as seen PRIOR times, so that small tables say little.
WORD, PRIOR = "^[a-z]{2,24}$", 20
#: Ways to see a token that the p-value pays for: six alphabets, with its own case or without.
WAYS = 12
#: Matches that are placed together, and code points of a text that are cut together.
BLOCK, CUT = 128, 16_384


_NO_SPANS = "CAST(array() AS array<struct<start:int,kind:int,end:int,token:string>>)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, kind, end, token>> of all matches, in code points; ``keep`` filters them by their texts.

    Matches are placed within blocks, and blocks after one another, so the arrays that grow stay short.
    """
    gaps = lambda found: F.slice(F.split(text, pattern, -1), 1, F.size(found))
    length = lambda x: F.length(x["gap"]) + F.length(x["found"])
    total = lambda rows: F.aggregate(rows, F.lit(0), lambda n, x: n + length(x))
    number = lambda: F.lit(KINDS.index(kind)).alias("kind")

    def placed(rows: Column, at: Column) -> Column:
        return F.aggregate(
            rows,
            F.struct(at.alias("at"), F.expr(_NO_SPANS).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + length(x)).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), number(), (acc["at"] + length(x)).alias("end"), x["found"].alias("token")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def whole(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, _starts(F.transform(bs, total)), placed)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = _let(found, lambda f: F.when(F.size(f) == 0, F.expr(_NO_SPANS)).otherwise(_let(F.arrays_zip(f.alias("found"), gaps(f).alias("gap")), whole)))
    return F.filter(every, lambda s: keep(s["token"])) if keep else every


def _starts(sizes: Column) -> Column:
    """For each size the sum of those before it."""
    none = F.expr("CAST(array() AS array<int>)")
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _replaced(text: Column, spans: Column, mask) -> Column:
    """The text with every span (sorted structs of start and end) replaced by ``mask(length)``; overlapping ones as one.

    The text is cut into pieces of CUT code points; each takes the spans that touch it.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

    def cut(piece: Column, n: Column) -> Column:
        first, last = n * CUT, n * CUT + F.length(piece)
        mine = F.filter(spans, lambda s: (s["start"] < last) & (s["end"] > first))
        part = lambda start, stop: F.substring(piece, start - first + 1, stop - start)
        joined = F.aggregate(
            mine,
            F.struct(first.alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["end"] <= acc["at"], acc["out"]).otherwise(F.concat(
                    acc["out"],
                    F.when(s["start"] >= acc["at"], F.array(part(acc["at"], s["start"]))).otherwise(F.expr("CAST(array() AS array<string>)")),
                    mask(F.greatest(s["start"], acc["at"]), s["end"], s["start"] >= acc["at"], last),
                )).alias("out"),
            ),
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.when(acc["at"] < last, part(acc["at"], last)).otherwise("")),
        )
        return F.when(F.size(mine) == 0, piece).otherwise(joined)

    return F.array_join(F.transform(pieces, cut), "")


def _filler(start: Column, end: Column, fresh: Column, last: Column) -> Column:
    """As many COVERED letters as the span has in this piece."""
    return F.array(F.repeat(F.lit(COVERED), F.least(end, last) - start))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds in one text, by start and then kind; documents without any cost one pass of plain searches."""
    lower = F.lower(text)
    hint = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    none = F.expr(_NO_SPANS)
    value = lambda token: F.length(F.regexp_extract(token, ASSIGN, 2)) >= 8
    return F.array_sort(
        F.concat(
            F.when(hint, _spans(text, ASSIGN, "assign", value)).otherwise(none),
            F.when(text.contains("AKIA"), _spans(text, ACCESS, "access")).otherwise(none),
            F.when(text.rlike(HEX), _spans(text, HEX, "hex")).otherwise(none),
        )
    )


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("int")
    for n in reversed(range(len(ALPHABETS))):
        out = F.when(token.rlike(ALPHABETS[n][1]), n).otherwise(out)
    return out


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a polynomial times the density (error under 1e-7, and small against the value in the tail)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _stages(rows: Column, names: tuple[str, ...], *stages) -> Column:
    """Add fields to the structs of an array, stage by stage, so that each value is computed once."""
    for stage in stages:
        made: list[str] = []

        def widened(s: Column) -> Column:  # used before the loop goes on
            new = stage(s)
            made[:] = list(new)
            return F.struct(*[s[n].alias(n) for n in names if n not in new], *[c.alias(n) for n, c in new.items()])

        rows = F.transform(rows, widened)
        names = (*[n for n in names if n not in made], *made)
    return rows


def letter_pairs(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often one letter follows another in the words of all texts: at most 676 numbers.

    Words are the runs of letters in what stands between blanks (up to 100 bytes of it), parted where capitals begin.
    """
    runs = docs.select(F.explode(F.split(text_of(text_col), " ")).alias("run")).filter(F.octet_length("run").between(2, 100))
    # patterns are matched once for each different run
    words = runs.groupBy("run").agg(F.count("*").alias("n")).select("n", F.explode(F.split("run", "(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")).alias("w"))
    counts = words.select("n", F.lower("w").alias("w")).filter(F.col("w").rlike(WORD))
    pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


_CODES = LOWER + UPPER + DIGITS + "+/-_"


def _class(code: int) -> int:
    return 0 if code < 26 else 1 if code < 52 else 2 if code < 62 else 3


def identifier_table(pairs: dict[str, int]) -> list[float]:
    """Log probability of each letter of _CODES after each, row by row."""
    totals = {a: sum(pairs.get(a + b, 0) for b in LOWER) for a in LOWER}
    follows = lambda a, b: 0.9 * (pairs.get(a + b, 0) + PRIOR) / (totals[a] + 26 * PRIOR) + 0.1 / 26
    out = []
    for i, a in enumerate(_CODES):
        for j, b in enumerate(_CODES):
            x, y = _class(i), _class(j)
            within = y < 2 and x < 2 and not (x == 0 and y == 1)
            letter = (follows(a.lower(), b.lower()) if within else 1 / 26) if y < 2 else 0.1 if y == 2 else 0.25
            out.append(_log(GOES_ON[x][y] * letter))
    return out


def _identifier_p(token: Column, encoding: Column, logs: Column) -> Column:
    """Bound of the probability that an identifier looks as random as this token; ``logs`` is the table as an array."""
    size = len(_CODES)
    own = F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token))
    spread = F.array(*[F.lit(_log(len(a[2]))) for a in ALPHABETS])
    uniform = F.when(token.rlike("^(?:[a-z]+|[A-Z]+)$"), _log(26)).otherwise(F.element_at(spread, encoding + 1))
    codes = F.transform(F.split(own, ""), lambda c: F.position(c, F.lit(_CODES)) - 1)
    steps = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda x, y: F.get(logs, x * size + y))
    likely = _let(codes, lambda c: F.aggregate(steps(c), F.lit(0.0), lambda acc, x: acc + x))
    return F.least(F.lit(1.0), WAYS * F.exp(F.least(F.lit(0.0), likely + (F.length(token) - 1) * uniform)))


def randomness(tokens: Column) -> Column:
    """From array<struct<start, end, token, encoding, id_p>> the array with length, bits, plain, id_p and p.

    p is Fisher's joint p-value of "random over its alphabet".
    """
    total = lambda values, of=lambda x: x: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))
    two_sided = lambda z: F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))
    letters = F.array(*[F.lit(a[2]) for a in ALPHABETS])
    tiny = F.lit(1e-9)

    def chi_squared(s: Column) -> Column:
        return _normal_tail((s["squares"] * s["k"] / s["n"] - s["n"] - (s["k"] - 1)) / F.sqrt(2 * (s["k"] - 1) * (1 - 1 / s["n"])))

    def runs(s: Column) -> Column:
        pairs = 2 * s["high"] * (s["n"] - s["high"])
        spread = pairs * (pairs - s["n"]) / (s["n"] * s["n"] * (s["n"] - 1))
        return F.when(spread > 0, two_sided((s["runs"] - pairs / s["n"] - 1) / F.sqrt(F.greatest(spread, tiny)))).otherwise(F.lit(1e-6))

    def serial(s: Column) -> Column:
        return F.when(s["spread"] > 0, two_sided((s["along"] / F.greatest(s["spread"], tiny) + 1 / s["n"]) * F.sqrt(s["n"]))).otherwise(F.lit(1e-6))

    rows = _stages(
        tokens,
        ("start", "end", "token", "encoding", "id_p"),
        lambda s: {"length": F.length(s["token"]), "plain": ~s["token"].rlike("[0-9]")},
        lambda s: {
            "token": F.when(s["encoding"].isin(0, 2), F.lower(s["token"])).otherwise(F.translate(s["token"], "-_", "+/")),
            "letters": F.element_at(letters, s["encoding"] + 1),
            "n": s["length"].cast("double"),
        },
        lambda s: {"chars": F.split(s["token"], ""), "k": F.length(s["letters"]).cast("double")},
        lambda s: {
            "values": F.transform(s["chars"], lambda c: F.position(c, s["letters"])),
            "squares": total(F.array_distinct(s["chars"]), lambda c: F.pow(s["n"] - F.length(F.replace(s["token"], c, F.lit(""))), F.lit(2.0))),
        },
        lambda s: {"half": F.transform(s["values"], lambda v: F.when(v > s["k"] / 2, 1.0).otherwise(0.0)), "mean": total(s["values"]) / s["n"]},
        lambda s: {"off": F.transform(s["values"], lambda v: v - s["mean"]), "high": total(s["half"])},
        lambda s: {
            "runs": 1 + total(F.zip_with(F.slice(s["half"], 1, s["length"] - 1), F.slice(s["half"], 2, s["length"]), lambda x, y: F.abs(x - y))),
            "spread": total(s["off"], lambda x: x * x),
            "along": total(F.zip_with(F.slice(s["off"], 1, s["length"] - 1), F.slice(s["off"], 2, s["length"]), lambda x, y: x * y)),
        },
        lambda s: {"fisher": -2 * (F.log(F.greatest(chi_squared(s), tiny)) + F.log(F.greatest(runs(s), tiny)) + F.log(F.greatest(serial(s), tiny)))},
    )
    p = lambda s: F.exp(-s["fisher"] / 2) * (1 + s["fisher"] / 2 + s["fisher"] * s["fisher"] / 8)
    return F.transform(rows, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), s["length"].alias("length"), s["plain"].alias("plain"), s["id_p"].alias("id_p"), p(s).alias("p")))


def _candidates(text: Column, base: Column, table: list[float], fdr: float) -> Column:
    """Token-like runs that no fixed kind touches: array<struct<start, end, stratum, step, bits>>.

    Runs without any letter are numbers or rules.  ``step`` is the p-value's place in the histogram, 0 for what can't be
    reported: the battery is spared tokens that an identifier may well be.
    """
    clean = F.when(text.contains(COVERED), F.translate(text, COVERED, " ")).otherwise(text)
    free = _let(clean, lambda t: F.when(F.size(base) > 0, _replaced(t, base, _filler)).otherwise(t))
    found = _let(free, lambda t: F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, "random", lambda token: ~token.contains(COVERED) & token.rlike("[A-Za-z]"))).otherwise(F.expr(_NO_SPANS)))
    # one string: a literal of thousands of numbers takes longer to plan than the search takes
    logs = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")

    def named(logs: Column) -> Column:
        return _stages(
            F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["token"], "=+$", "").alias("token"))),
            ("start", "end", "token"),
            lambda s: {"encoding": _encoding(s["token"])},
            lambda s: {"id_p": _identifier_p(s["token"], s["encoding"], logs)},
        )

    size = F.array(*[F.lit(_log(len(a[2]), 2)) for a in ALPHABETS])
    judged = lambda c, step: F.struct(c["start"].alias("start"), c["end"].alias("end"), _stratum(c).alias("stratum"), step.alias("step"), (c["length"] * F.element_at(size, c["encoding"] + 1)).alias("bits"))

    def split(every: Column) -> Column:
        tested = F.transform(randomness(F.filter(every, lambda s: s["id_p"] <= fdr)), lambda c: judged(c, F.when(c["p"] >= LEAST_P, _step(c["id_p"])).otherwise(0)))
        other = _stages(F.filter(every, lambda s: ~(s["id_p"] <= fdr)), ("start", "end", "token", "encoding", "id_p"), lambda s: {"length": F.length(s["token"]), "plain": ~s["token"].rlike("[0-9]")})
        return F.concat(tested, F.transform(other, lambda c: judged(c, F.lit(0))))

    return F.when(F.size(found) > 0, _let(_let(logs, named), split)).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,stratum:int,step:int,bits:double>>)"))


def _stratum(c: Column) -> Column:
    return (c["encoding"] * BANDS + F.least(F.floor(c["length"] / BAND), F.lit(BANDS - 1)).cast("int")) * 2 + c["plain"].cast("int")


def _step(p: Column) -> Column:
    return F.least(F.greatest(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(0)), F.lit(STEPS * DECADES)).cast("int")


def accepted_steps(candidates: DataFrame, fdr: float = 0.05) -> dict[int, int]:
    """For each stratum the histogram step (the largest p-values) from which on tokens are reported.

    ``candidates`` has a column c of single candidates.  A step's tokens have p-values of at most 10 ** (-step / STEPS);
    of m candidates of which r reach it, m times that many are expected to be identifiers.  What reaches the driver is
    a table of at most strata x steps counts, whatever the number of documents.
    """
    rows = candidates.select("c.stratum", "c.step").groupBy("stratum", "step").count().collect()
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        counts = dict((r["step"], r["count"]) for r in rows if r["stratum"] == stratum)
        total, reached = sum(counts.values()), 0
        for step in sorted(counts, reverse=True):
            reached += counts[step]
            if step and total * 10 ** (-step / STEPS) <= fdr * reached:
                out[stratum] = step
    return out


def _random_spans(candidates: Column, steps: dict[int, int], min_bits: float) -> Column:
    accepted = F.create_map(*[F.lit(x) for pair in sorted(steps.items()) for x in pair]) if steps else None

    def kept(c: Column) -> Column:
        return F.lit(False) if accepted is None else (c["bits"] >= min_bits) & (c["step"] >= F.coalesce(F.element_at(accepted, c["stratum"]), F.lit(STEPS * DECADES + 1)))

    return F.transform(F.filter(candidates, kept), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _with_spans(docs: DataFrame, text_col: str, table: list[float], fdr: float) -> DataFrame:
    """Columns _base and _found; the search runs once for each row."""
    return docs.withColumn("_base", base_spans(text_of(text_col))).withColumn("_found", _candidates(text_of(text_col), F.col("_base"), table, fdr))


def scan(docs: DataFrame, *, fdr: float = 0.05, min_bits: float = 80.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for each row.

    Null and empty texts have no spans (counts 0, the digest of the empty string, spans ""); repeated rows
    and null ids come back as they came; an empty table gives an empty result; other columns are not read.
    Texts are searched whole.  Spans, not texts, are written between the two passes.
    """
    table = identifier_table(letter_pairs(docs, text_col))
    found = _with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", table, fdr)
    found = written(found.select("_id", _plain(F.col("_base")).alias("_base"), "_found"), "secrets")
    steps = accepted_steps(found.select(F.explode("_found").alias("c")), fdr)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    extra = _random_spans(F.col("_found"), steps, min_bits)
    return found.select(
        F.col("_id").alias(id_col), count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_base", extra))).alias("spans"),
        F.size(extra).cast("bigint").alias("n_random"),
    )


def redact(docs: DataFrame, *, mask: str = "[SECRET]", fdr: float = 0.05, min_bits: float = 80.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of the text replaced by ``mask``; texts without spans, nulls included, stay as they are.

    Overlapping spans give one mask.  All columns stay, whatever their names (but not names that begin with ``_``
    and are used here: _base, _found and _spans).
    """
    table = identifier_table(letter_pairs(docs, text_col))
    found = _with_spans(docs.select(F.col(text_col)), text_col, table, fdr).select(F.explode("_found").alias("c"))
    steps = accepted_steps(found, fdr)
    spans = F.array_sort(F.concat(_plain(F.col("_base")), _random_spans(F.col("_found"), steps, min_bits)))
    text = F.col(text_col)
    found = _with_spans(docs, text_col, table, fdr).withColumn("_spans", spans)
    whole = _replaced(text, F.col("_spans"), lambda start, end, fresh, last: F.when(fresh, F.array(F.lit(mask))).otherwise(F.expr("CAST(array() AS array<string>)")))
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, whole).otherwise(text)).drop("_base", "_found", "_spans")
