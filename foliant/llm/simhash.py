"""SimHash near-duplicates: segment popcounts as an embedding, a grid range join, exact verification.

A fingerprint's 64 bits fall into segments; their bit counts are its place in a small space.  Flipping a
bit moves that place by one, so the Manhattan distance of two places never exceeds the Hamming distance.
With more segments than the allowed distance some segments must agree, and so must their counts: the grid has
one cell for each choice of agreeing segments and their counts, and two fingerprints within the distance share
a cell.  A crowded cell is refined by the contents of its agreeing segments, which pairs within the distance
share as well.  The Manhattan bound over the other segments drops most chance meetings, and the exact Hamming
distance decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.tables import sized

from .common import map_arrow, written
from .graph import components

#: Shingles whose bits are counted in one numpy call.
BLOCK = 60_000
#: Distinct fingerprints of one cell up to which all its pairs are compared; larger cells link through hubs.
HOT_CELL = 512
#: Fingerprints of a cell of equal counts from which on it is refined by contents.
CROWDED = 64


def fingerprint_all(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts: bit set where over half the shingle hashes have it; none: zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    rows: list[bytes] = []
    owners: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if sizes:
            bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8)).reshape(-1, 64)
            starts = np.cumsum([0, *sizes[:-1]])
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[owners] = np.packbits(counts * 2 > np.array(sizes)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        rows.clear(), owners.clear(), sizes.clear()

    held = 0
    for at, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], seed) for a, b in spans])
        if n > BLOCK:
            counts = sum(np.unpackbits(np.frombuffer(digests[i : i + 8 * BLOCK], np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for i in range(0, len(digests), 8 * BLOCK))
            out[at] = int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")
            continue
        rows.append(digests)
        owners.append(at)
        sizes.append(n)
        held += n
        if held > BLOCK:
            flush()
            held = 0
    flush()
    return out


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (the 64 bits as a signed long) and the columns of ``keep`` for each row; null texts count as empty."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield {id_col: batch.column(0), "fp": pa.array(fingerprint_all(texts, shingle, seed).view(np.int64)), **{k: batch.column(2 + n) for n, k in enumerate(keep)}}

        return step

    kind = lambda name: f"`{name}` {docs.schema[name].dataType.simpleString()}"
    return map_arrow(docs.select(id_col, text_col, *keep), make, ", ".join([kind(id_col), "fp bigint", *map(kind, keep)]))


def _segments(distance: int) -> list[int]:
    """Bit masks of the segments: three more than the distance, which leaves a choice of three to agree."""
    n = distance + 3
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cells(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """node, fp, choice, bits: a row for each cell of each fingerprint; two within ``distance`` share a cell."""
    segments = _segments(distance)
    each = [F.struct(F.lit(n).cast("tinyint").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(sum(segments[i] for i in c)))).alias("bits")) for n, c in enumerate(combinations(range(len(segments)), 3))]
    return nodes.select("node", "fp", F.explode(F.array(*each)).alias("cell")).select("node", "fp", "cell.choice", "cell.bits")


def grid(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """node, fp, choice, refined, bits: a row for each cell of each fingerprint; bits are the counts of the choice's segments, or where many share these its contents."""
    segments = _segments(distance)
    packed = []
    for choice in combinations(range(len(segments)), 3):
        counts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(segments[i])))) for i in choice]
        packed.append(sum((F.shiftleft(c.cast("bigint"), 8 * n) for n, c in enumerate(counts)), F.lit(0).cast("bigint")))
    placed = cells(nodes, distance).withColumn("counts", F.element_at(F.array(*packed), F.col("choice").cast("int") + 1))
    # a choice has at most the product of its segments' lengths plus one as many cells: some thousands for distance 3
    crowded = written(placed.groupBy("choice", "counts").agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWDED).select("choice", "counts", F.lit(True).alias("refined")), "crowded-cells")
    own = placed.join(sized(crowded), ["choice", "counts"], "left").withColumn("refined", F.coalesce("refined", F.lit(False)))
    return own.select("node", "fp", "choice", "refined", F.when(F.col("refined"), F.col("bits")).otherwise(F.col("counts")).alias("bits"))


def links(nodes: DataFrame, *, distance: int = 3, hot_cell: int | None = HOT_CELL) -> DataFrame:
    """u, v: ids of distinct fingerprints (node, fp) whose components are those of all pairs within ``distance``.

    Cells up to ``hot_cell`` give all their verified pairs.  In larger ones each fingerprint reaches the
    points around it instead, and all that are near a point link to one fingerprint there: the number of
    rows is linear in the cell's size and no connection is lost (see ``_through_hubs``).  That is worked out for
    a distance of 3; for another give ``hot_cell`` None, and all cells give their pairs.
    """
    if distance != 3 and hot_cell is not None:
        raise ValueError("crowded cells are linked through hubs for a distance of 3 only; give hot_cell=None")
    segments = _segments(distance)
    choices = list(combinations(range(len(segments)), 3))
    placed = grid(nodes, distance)
    key = ["choice", "refined", "bits"]
    shared = placed.groupBy(*key).agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(shared, "cells")
    near = placed.join(shared, key)
    if hot_cell is None:
        hot_cell = (1 << 63) - 1
    small = near.filter(F.col("members") <= hot_cell).drop("members")
    left, right = small.alias("a"), small.alias("b")
    bound = sum((F.abs(F.bit_count(F.col("a.fp").bitwiseAND(F.lit(_signed(m)))) - F.bit_count(F.col("b.fp").bitwiseAND(F.lit(_signed(m))))) for m in segments), F.lit(0))
    found = left.join(
        right,
        (F.col("a.choice") == F.col("b.choice")) & (F.col("a.refined") == F.col("b.refined")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & (bound <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance),
    ).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    if shared.filter(F.col("members") > hot_cell).limit(1).count():
        found = found.union(_through_hubs(near.filter(F.col("members") > hot_cell), [sum(segments[i] for i in range(len(segments)) if i not in c) for c in choices]))
    return found


def _through_hubs(members: DataFrame, free: list[int]) -> DataFrame:
    """Links of crowded cells for a distance of 3, in rows linear in the members.

    Two fingerprints that differ in at most three free bits have a point within 1 of the one and within 2
    of the other.  At each point, all fingerprints within 2 link to the least one within 1 (if any): such
    links span at most 3, and both ends of every close pair meet at a common one.
    """
    bits = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(64) if m >> b & 1]) for m in free]), F.col("choice").cast("int") + 1)
    ones = F.concat(F.array(F.lit(0).cast("bigint")), F.col("bits_free"))
    own = members.withColumn("bits_free", bits)
    near = own.select("node", "choice", F.explode(F.transform(ones, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    pairs = F.flatten(F.transform(F.col("bits_free"), lambda x, i: F.transform(F.slice(F.col("bits_free"), i + 2, F.size("bits_free")), lambda y: F.col("fp").bitwiseXOR(x.bitwiseXOR(y)))))
    far = own.select("node", "choice", F.explode(pairs).alias("point"))
    hubs = near.groupBy("choice", "point").agg(F.min("node").alias("hub"))
    return near.union(far).join(hubs, ["choice", "point"]).filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, distance: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", hot_cell: int | None = HOT_CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable over links) for each row.

    Null and empty texts have the fingerprint zero and link like any other.  Equal fingerprints are one
    node, so any number of copies costs one comparison.  Repeated rows come back as they came; rows with a
    null id get their fingerprint and, unless linked to a row with an id, a null component.  An empty table
    gives an empty result; other columns are not read.
    """
    prints = written(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    # fingerprints are the nodes, so that one whose rows have no id still links its neighbours
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    labels = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance=distance, hot_cell=hot_cell))
    placed = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    homes = placed.join(least, "component").select("fp", "component_id")
    return prints.join(homes, "fp").select(id_col, hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
