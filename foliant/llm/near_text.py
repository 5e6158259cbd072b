"""Near copies by the similarity of their five-word shingles, for filtering.

SimHash links at a small Hamming distance find the closest copies only: at a Jaccard similarity of 0.8 the
fingerprints of two texts differ in about ten of 64 bits, far beyond what a grid can join.  So candidates
come from both the SimHash grid and MinHash bands, and exact Jaccard similarity of the shingle sets decides.
Where too many texts share a band value for all their pairs, a prefix-filter join finds every similar pair
that the first links have left apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import map_arrow, written
from .graph import components
from .positions import sized

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band of 5 least hashes out of 16 with probability 0.002.
BANDS, ROWS = 16, 5
#: Texts of one band value up to which all their pairs are candidates; larger ones are joined by their shingles.
SMALL_BUCKET = 24
#: Ids of dropped rows up to which they are broadcast (8 bytes each), which spares the texts a shuffle.
BROADCAST_IDS = 2_000_000
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
_MULTIPLY, _ADD = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of all shingles in order; fewer words than ``size`` are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], 42) for a, b in spans]), ">u8").astype(np.uint64)


def _bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band values (texts, BANDS): each joins ROWS least re-hashed shingles of a text."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(hashes * _MULTIPLY[k] + _ADD[k], starts)
        out[:, k // ROWS] = out[:, k // ROWS] * np.uint64(0x100000001B3) + (least ^ (least >> np.uint64(31)))
    return out


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, words (hash of the word sequence), fp (SimHash) and bands; texts without words have no bands."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            words = [xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 5) for t in texts]
            fp = np.zeros(len(texts), np.uint64)
            bands = np.zeros((len(texts), BANDS), np.uint64)
            filled = np.zeros(len(texts), bool)
            group, parts, held = [], [], 0
            for at, text in enumerate(texts):
                if len(found := shingle_hashes(text, size)):
                    group.append(at)
                    parts.append(found)
                    held += len(found)
                if group and (held > 400_000 or at + 1 == len(texts)):
                    hashes = np.concatenate(parts)
                    sizes = np.array([len(p) for p in parts])
                    starts = np.cumsum(sizes) - sizes
                    bands[group] = _bands(hashes, starts)
                    fp[group] = _fingerprints(hashes, starts, sizes)
                    filled[group] = True
                    group, parts, held = [], [], 0
            rows = [b.tolist() if f else [] for b, f in zip(bands.view(np.int64), filled)]
            yield {"id": batch.column(0), "words": pa.array(np.array(words, np.uint64).view(np.int64)), "fp": pa.array(fp.view(np.int64)), "bands": rows}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), make, f"id {kind}, words bigint, fp bigint, bands array<bigint>")


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for n in range(0, 64, 8):  # eight bits at a time keep the unpacked block small
        part = ((hashes >> np.uint64(n)) & np.uint64(255)).astype(np.uint8)
        counts = np.add.reduceat(np.unpackbits(part[:, None], axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
        out |= np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(n)
    return out


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs u, v (u < v) of distinct texts (node, fp, bands) that may be similar, and the crowded texts (id).

    Small buckets give all their pairs.  In a larger one every text meets three centres: the one that meets
    most texts over all its buckets (the original of a family of edits, typically), the least id, and one
    that each band draws anew; the rows stay linear in the bucket.  That joins families cheaply and leaves
    pairs out, so the texts of larger buckets are crowded: their other pairs are for ``apart``.  So are those
    of SimHash cells that link through hubs only, and of fingerprints that many texts have.
    """
    placed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    sized = placed.groupBy("band", "value").agg(F.count("*").alias("members")).filter("members > 1")
    met = written(placed.join(sized, ["band", "value"]), "buckets")
    small, large = met.filter(F.col("members") <= SMALL_BUCKET), met.filter(F.col("members") > SMALL_BUCKET)
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.node") < F.col("b.node"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    weight = large.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = large.join(weight, "node")
    centres = weighed.groupBy("band", "value").agg(
        F.array_distinct(F.array(F.min_by("node", F.struct(-F.col("weight"), F.col("node"))), F.min("node"), F.min_by("node", F.struct(F.xxhash64("node", "band"), "node")))).alias("centres")
    )
    stars = large.join(centres, ["band", "value"]).select("node", F.explode("centres").alias("centre")).filter("node <> centre").select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v"))
    close, packed = _close(nodes.select("node", "fp"))
    return pairs.union(stars).union(close).distinct(), large.select(F.col("node").alias("id")).union(packed).distinct()


def _close(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs u, v (u < v) of texts (node, fp) with equal or close fingerprints, and the crowded texts (id).

    ``simhash.links`` wants distinct fingerprints, so the least text of each stands for all that have it.
    """
    stands = nodes.groupBy("fp").agg(F.min("node").alias("home"), F.count("*").alias("texts"))
    texts = written(nodes.join(stands, "fp"), "prints")
    homes = texts.filter("node = home").select("node", "fp", "texts")
    met = written(simhash.links(homes.select("node", "fp")), "close")
    size = lambda side: homes.select(F.col("node").alias(side), F.col("texts").alias(f"{side}_texts"))
    met = met.join(size("u"), "u").join(size("v"), "v").withColumn("most", F.greatest("u_texts", "v_texts"))
    own = homes.filter(f"texts BETWEEN 2 AND {SMALL_BUCKET}").select(F.col("node").alias("u"), F.col("node").alias("v"))
    of = lambda side: texts.select(F.col("home").alias(side), F.col("node").alias(f"{side}_text"))
    small = met.filter(F.col("most") <= SMALL_BUCKET).select("u", "v").union(own).join(of("u"), "u").join(of("v"), "v")
    pairs = small.filter("u <> v OR u_text < v_text").select(F.least("u_text", "v_text").alias("u"), F.greatest("u_text", "v_text").alias("v"))
    stars = texts.filter(f"texts > {SMALL_BUCKET} AND node <> home").select(F.col("home").alias("u"), F.col("node").alias("v"))
    ends = met.filter(F.col("most") > SMALL_BUCKET).select(F.explode(F.array("u", "v")).alias("home")).union(homes.filter(F.col("texts") > SMALL_BUCKET).select("node"))
    placed = simhash.cells(homes)
    hot = placed.groupBy("choice", "bits").agg(F.count("*").alias("members")).filter(F.col("members") > simhash.HOT_CELL)
    ends = ends.union(placed.join(sized(written(hot, "hot")), ["choice", "bits"]).select("node")).distinct()
    return pairs.union(stars), texts.join(ends, "home", "left_semi").select(F.col("node").alias("id"))


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, set (distinct shingle hashes) of the documents that ``ids`` names."""
    named = sized(ids)

    def make():
        def step(batch: pa.RecordBatch):
            sets = [np.unique(shingle_hashes(t or b"", size)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            yield {"id": batch.column(0), "set": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(named, "id", "left_semi")
    sets = written(map_arrow(mine, make, f"id {kind}, set array<bigint>"), "shingles")
    rows = sets.agg(F.count("*"), F.count_distinct("id")).first()
    if rows[0] > rows[1]:  # rows that share an id count as one document
        sets = sets.dropDuplicates(["id"])
    return sets


def similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the Jaccard ``similarity``."""
    # the pairs go to the sets, and only what they pick is shuffled
    few = sized(pairs)
    left = sets.join(few, F.col("id") == F.col("u")).select("u", "v", F.col("set").alias("x"))
    right = sets.join(few, F.col("id") == F.col("v")).select("u", "v", F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = left.join(right, ["u", "v"]).filter(F.least(F.size("x"), F.size("y")) >= F.lit(similarity - 1e-9) * F.greatest(F.size("x"), F.size("y")))
    return joined.withColumn("both", both).filter(F.col("both") >= F.lit(similarity - 1e-9) * (F.size("x") + F.size("y") - F.col("both"))).select("u", "v")


def apart(sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """u, v (u < v): every pair of ``sets`` that can reach ``similarity`` and has two different ``labels``.

    Labels (node, component) are those of the links found so far; a text without one is its own.  Shingles
    are put in one order: first those that only one label has, which no pair in question shares, then the
    rarest.  The first shingle that a pair shares lies so early in both sets that enough can follow it:
    within the leading 20 % of the larger and 11 % of the smaller at a similarity of 0.8.  So the join on
    these beginnings, with the bounds of sizes and places, leaves out no similar pair.
    """
    least = similarity - 1e-9
    share, slack = least / (1 + least), 1e-6
    own = sets.join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"), F.size("set").alias("size"), "set")
    each = own.select("id", "label", "size", F.explode("set").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle", "texts")
    ranked = each.join(sized(written(shared, "shared")), "shingle").groupBy("id", "label", "size").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("row"))
    # rest: shingles of the set from this one on
    begun = ranked.select("id", "label", "size", F.size("row").alias("rest"), F.posexplode("row").alias("at", "s")).select("id", "label", "size", (F.col("rest") - F.col("at")).alias("rest"), "s.shingle")
    begun = written(begun.filter(F.col("rest") >= least * F.col("size") - slack), "beginnings")
    a, b = begun.filter(F.col("rest") >= 2 * share * F.col("size") - slack).alias("a"), begun.alias("b")
    met = a.join(
        b,
        (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.label") != F.col("b.label")) & (F.struct("a.size", "a.id") < F.struct("b.size", "b.id"))
        & (F.col("a.size") >= least * F.col("b.size") - slack) & (F.least("a.rest", "b.rest") >= share * (F.col("a.size") + F.col("b.size")) - slack),
    )
    return met.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) with the components that ``links`` (u, v) connect made one."""
    named = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_home"))
    over = links.join(named("u"), "u", "left").join(named("v"), "v", "left")
    homes = components(over.select(F.coalesce("u_home", "u").alias("u"), F.coalesce("v_home", "v").alias("v")))
    moved = labels.join(homes.select(F.col("node").alias("component"), F.col("component").alias("home")), "component", "left")
    return moved.select("node", F.coalesce("home", "component").alias("component")).union(homes.join(labels, "node", "left_anti").select("node", "component"))


def groups(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, group_id (the least id reachable): one row for each id of ``docs``.

    Equal word sequences are equal; empty and null texts are equal to one another.  Rows that share an id
    count as one document; rows without an id are in no group.
    """
    own = docs.filter(F.col(id_col).isNotNull())
    made = written(sketches(own, shingle, id_col, text_col), "sketches")
    first = written(made.groupBy("words").agg(F.min("id").alias("node")), "first")
    nodes = made.join(first.select("words", F.col("node").alias("id")), ["words", "id"], "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("node"), "fp", "bands")
    nodes = written(nodes, "nodes")
    pairs, crowded = candidates(nodes.filter(F.size("bands") > 0))
    pairs, crowded = written(pairs, "pairs"), written(crowded, "crowded")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).union(crowded).distinct()
    sets = shingle_sets(own, ids, shingle, id_col, text_col)
    labels = components(similar(sets, pairs, similarity))
    if crowded.limit(1).count():
        pairs = written(apart(sets.join(sized(crowded), "id", "left_semi"), labels, similarity), "pairs")
        labels = merged(labels, written(similar(sets, pairs, similarity), "links"))
    homes = first.join(labels, "node", "left").select("words", F.coalesce("component", "node").alias("group_id"))
    return made.join(homes, "words").groupBy("id").agg(F.min("group_id").alias("group_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group, in all their columns.

    Rows without an id stay: nothing names them as a copy.  Of rows that repeat an id one stays.
    """
    found = written(groups(docs, id_col=id_col, **options), "groups")
    gone = sized(found.filter("id <> group_id").select(F.col("id").alias("_gone")), BROADCAST_IDS)
    kept = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    ids = docs.filter(F.col(id_col).isNotNull()).agg(F.count("*"), F.count_distinct(id_col)).first()
    if ids[0] > ids[1]:
        kept = kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.filter(F.col(id_col).isNull()))
    return kept
