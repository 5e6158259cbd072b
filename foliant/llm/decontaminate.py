"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which words of a span count; the others may differ.  Masked hashes of every benchmark
position meet those of every document position in one join.  Each hit aligns a document with an item;
along that alignment the operator counts equal words, so substitutions are tolerated, and reports the
pair if some stretch of ``window`` words (the whole item, if shorter) has at least ``similarity`` of them.

The default masks are complete for the default window: however two of its 13 words are substituted, one
of the masks still hits.  Items shorter than the window have masks of their own, complete for as many
substitutions as the similarity allows them (``tests/llm`` tries all cases of both).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .positions import at_positions, sized, with_words, word_hash

#: Offsets that count, in spans of 8 words.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Items with fewer words overlap with nothing: with none to leave out, empty ones alone.
LEAST_WORDS = 1
#: Masks of one short length at most, as each is hashed at every document position; and cases tried to find them.
MOST_MASKS, MOST_CASES = 4, 5000


def _places(mask: tuple[int, ...], length: int) -> list[frozenset[int]]:
    return [frozenset(x + o for x in mask) for o in range(length - mask[-1])]


@cache
def masks_of(length: int, similarity: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which one hits a stretch of ``length`` words however many ``similarity`` allows to differ.

    The heaviest masks of which MOST_MASKS suffice, each chosen for the most cases it adds; else the longest
    run of words that is always left.
    """
    equal = max(1, ceil(length * similarity - 1e-9))
    run = ceil(equal / (length - equal + 1))
    if comb(length, equal) <= MOST_CASES:
        cases = [frozenset(c) for c in combinations(range(length), equal)]
        for weight in range(equal, run, -1):
            hit = {m: {c for c in cases if any(p <= c for p in _places(m, length))} for m in ((0, *rest) for rest in combinations(range(1, length), weight - 1))}
            left, chosen = set(cases), []
            while left and len(chosen) < MOST_MASKS:
                chosen.append(max(hit, key=lambda m: len(hit[m] & left)))
                left -= hit[chosen[-1]]
            if not left:
                return tuple(chosen)
    return (tuple(range(run)),)


def _seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row for each position and mask: column _seed, null where the mask doesn't fit.  Mask and length are part of the hash."""
    span = min(m[-1] for m in masks) + 1
    fits = lambda m: F.col("_pos") + m[-1] < F.size("_words")
    hashes = F.array(*[h if m[-1] < span else F.when(fits(m), h) for n, m in enumerate(masks) for h in [word_hash(m, 1000 * span + n)]])
    return at_positions(rows, span).select("*", F.explode(hashes).alias("_seed"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 13, similarity: float = 0.8, masks: tuple[tuple[int, ...], ...] = MASKS, least_words: int = LEAST_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_aligned, n_equal: one row for each pair with an overlap, its best alignment.

    Words are lower-cased runs between white space.  Items shorter than ``window`` are seeded by ``masks_of`` their length;
    items under ``least_words`` and null or empty texts and items overlap with nothing; repeated items give one pair; repeated document rows
    give one pair for each id; a null id is kept as null.  Empty tables give an empty result, and other
    columns are not read.
    """
    span = max(m[-1] for m in masks) + 1
    items = with_words(benchmark, item_col, item_text_col).filter(F.size("_words") >= least_words).dropDuplicates(["_id", "_key"]).select(F.col("_id").alias("_item"), F.col("_key").alias("_item_key"), "_words")
    rows = with_words(docs, id_col, text_col)
    whole = max(span, window)
    short = sorted(r[0] for r in items.select(F.size("_words").alias("n")).filter(F.col("n") < whole).distinct().collect())  # at most whole - 1 lengths
    kinds = [(masks, F.size("_words") >= whole), *[(masks_of(min(n, window), similarity), F.size("_words") == n) for n in short]]
    hits = None
    for kind, of_items in kinds:
        known = sized(_seeds(items.filter(of_items), kind).select("_seed", "_item_key", F.col("_pos").alias("_item_pos"), F.size("_words").alias("_n")))
        found = _seeds(rows, kind).join(known, "_seed").select(
            "_id", "_key", "_item_key", (F.col("_pos") - F.col("_item_pos")).alias("_shift"),
            F.slice("_words", F.greatest(F.col("_pos") - F.col("_item_pos"), F.lit(0)) + 1, F.col("_n") + F.least(F.col("_pos") - F.col("_item_pos"), F.lit(0))).alias("_part"),
        )
        hits = found if hits is None else hits.union(found)
    # an alignment's hits carry the same slice of the document, at most as long as the item
    aligned = hits.groupBy("_id", "_key", "_item_key", "_shift").agg(F.first("_part").alias("_part"))
    equal = aligned.join(sized(items), "_item_key").withColumn("_equal", _equal_words()).withColumn("_best", _best_stretch(window))
    kept = equal.filter(F.col("_best.equal") >= F.ceil(F.least(F.lit(window), F.size("_words")) * F.lit(similarity) - 1e-9))
    best = kept.groupBy("_id", "_item").agg(
        F.max_by(
            F.struct((F.col("_shift") - F.col("_best.back")).alias("doc_start"), (-F.col("_best.back")).alias("item_start"), F.size("_words").alias("n_aligned"), _total(F.col("_equal")).alias("n_equal")),
            F.struct(_total(F.col("_equal")), F.col("_best.equal"), -F.col("_shift")),
        ).alias("_b")
    )
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "_b.*")


def _total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda a, x: a + x)


def _equal_words() -> Column:
    """1 or 0 for each word of the item: whether the document has the same word there."""
    return F.transform(F.col("_words"), lambda w, i: F.coalesce((F.get(F.col("_part"), i + F.least(F.col("_shift"), F.lit(0))) == w).cast("int"), F.lit(0)))


def _best_stretch(window: int) -> Column:
    """struct<equal, back>: the stretch of the item with the most equal words, the first of these; it begins at -back."""
    size = F.least(F.lit(window), F.size("_words"))
    places = F.sequence(F.lit(0), F.size("_words") - size)
    return F.array_max(F.transform(places, lambda i: F.struct(_total(F.slice(F.col("_equal"), i + 1, size)).alias("equal"), (-i).alias("back"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, in all their columns.

    A row with a null id stays or goes by its own text: rows are told apart by id and text, not by id alone.
    """
    found = overlaps(docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash")).alias("_row"), F.col(text_col)), benchmark, id_col="_row", text_col=text_col, **options)
    gone = written(found.select(F.col("_row.id").alias("_gone_id"), F.col("_row.hash").alias("_gone_hash")).distinct(), "leaks")
    gone = sized(gone)  # spares the texts a shuffle
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(text_of(docs[text_col])) == gone["_gone_hash"]), "left_anti")
