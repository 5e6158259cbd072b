"""Language-model scores by context-tree weighting.

Each byte is eight binary decisions; each decision has a tree of contexts, the bytes before it, up to a
depth.  Every node of a tree has a Krichevsky-Trofimov estimate of its own counts and a weighted
probability: half its own estimate, half the product of its children's.  The mixture over all depths that
these weights give is the model's probability of the next bit.

Counts are sums over all training documents.  The trees fall apart below three bytes of context: parts
are evaluated where their rows are, a few contexts and one of the eight decisions at a time.  The level
above them is a table of at most 65,536 x 255 nodes, made and summed on the executors; of the levels above
that the driver gets at most 256 x 255 nodes.

Documents are read in batches of about BATCH_BYTES.  Each batch has the distinct byte strings (depth + 1
bytes) and words of its texts, as sorted arrays by bucket (a hash of the three context bytes, or of the word).
A bucket's arrays of all batches meet in one task, which sums their counts, and again once the model is
there, which then says what each batch's strings cost; that goes to one small file for the batch, which the
scoring pass reads beside the batch's texts.  So every pass is linear in the documents, and a task holds one
batch, or the distinct strings of one bucket.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, keeps, map_arrow, new_path, written
from .files import read_table, save_table

#: Bytes of context.
DEPTH = 5
#: Context bytes below which the trees are evaluated in parts.
TOP = 3
#: Closes each text and fills the contexts before its start; no UTF-8 text has this byte.
END = b"\xff"
#: The key of the token that closes a document; a word's key is its hash.
END_KEY = xxhash.xxh64_intdigest(b"", 1)
#: Strings that are evaluated together (more only if one context has them).
CHUNK_ROWS = 60_000
#: Bytes that are coded at a time, and bytes of documents that share one file of code lengths.
UNIT_BYTES, BATCH_BYTES = 2_000_000, 64_000_000
#: Least and most buckets, and bytes of input for each between.
BUCKETS, BUCKET_BYTES = (48, 4096), 16 << 20


def _gammaln(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5 (recurrence to 8 and more, then Stirling's series; error under 1e-12)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _gammaln(zeros + 0.5) + _gammaln(ones + 0.5) - _gammaln(zeros + ones + 1.0) - log(np.pi)


class Level:
    """All nodes of one depth: sorted keys (context, bit prefix), counts, weighted log probability."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """``below``: the sum of the children's weighted log probabilities (None at full depth)."""
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = _log_kt(zeros, ones)
        self.weighted = own if below is None else np.logaddexp(own, below) - log(2)
        self.chance = (ones + 0.5) / (zeros + ones + 1.0)
        self.own_share = np.ones(len(keys)) if below is None else np.exp(own - self.weighted - log(2))

    def sums(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the parents of these nodes (at ``depth``) and the sums of zeros, ones and weighted log probabilities."""
        keys, at = np.unique(_parent(self.keys, depth), return_inverse=True)
        return keys, *(np.bincount(at, weights=x, minlength=len(keys)) for x in (self.zeros, self.ones, self.weighted))

    def step(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | float) -> np.ndarray:
        """The mixture's probability of ``bit`` at nodes ``at``, given that of the next depth."""
        return _mixed(self.chance[at], self.own_share[at], bit, deeper)


def _mixed(chance: np.ndarray, share: np.ndarray, bit: np.ndarray, deeper: np.ndarray | float) -> np.ndarray:
    return share * np.where(bit, chance, 1 - chance) + (1 - share) * deeper


def _decision(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit prefix (1 to 255) and bit of the n-th decision of each row's last byte."""
    byte = (grams & np.uint64(255)).astype(np.uint16)
    return (np.uint16(1 << n) | (byte >> np.uint16(8 - n))).astype(np.uint64), (byte >> np.uint16(7 - n)) & np.uint16(1) > 0


def _keys(grams: np.ndarray, prefixes: np.ndarray, depth: int) -> np.ndarray:
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return (context << np.uint64(8)) | prefixes


def _parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions with the farthest of ``depth`` context bytes left out."""
    return keys & np.uint64((1 << 8 * depth) - 1)


def evaluate(grams: np.ndarray, counts: np.ndarray, depth: int, top: int, n: int, mix: bool) -> tuple[Level, np.ndarray | None]:
    """The level at ``top`` of the n-th decision and, if asked for, each row's mixture from full depth up to there.

    The rows must be all those of their contexts at ``top``.
    """
    prefixes, bit = _decision(grams, n)
    level, mixed = None, 0.5
    for d in range(depth, top - 1, -1):
        keys, at = np.unique(_keys(grams, prefixes, d), return_inverse=True)
        total, ones = np.bincount(at, weights=counts), np.bincount(at, weights=counts * bit)
        below = None
        if level is not None:
            parents, _, _, sums = level.sums(d + 1)
            below = np.zeros(len(keys))
            below[np.searchsorted(keys, parents)] = sums
        level = Level(keys, total - ones, ones, below)
        if mix:
            mixed = level.step(at, bit, mixed)
    return level, mixed if mix else None


def join_top(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int) -> list[Level]:
    """The level at ``top`` from its nodes' sums (in the order of the keys) and those above it, down to depth 0."""
    out = [Level(keys, zeros, ones, below)]
    for d in range(top, 0, -1):
        out.append(Level(*out[-1].sums(d)))
    return out


def _chunks(grams: np.ndarray, counts: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows in groups of whole contexts."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1)
    order = np.argsort(context, kind="stable")
    grams, counts, context = grams[order], counts[order], context[order]
    borders = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(grams))
    start = 0
    while start < len(grams):
        full = np.searchsorted(borders, start + CHUNK_ROWS, side="right")
        stop = int(borders[full - 1]) if full and borders[full - 1] > start else int(borders[np.searchsorted(borders, start, side="right")])
        yield grams[start:stop], counts[start:stop]
        start = stop


def _units(texts: list[bytes], depth: int, most: int = 0) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of about UNIT_BYTES of (text number, context and bytes to code); a longer text comes in several units.

    Every text gives its bytes and the end, so an empty text gives one place.
    """
    most = most or UNIT_BYTES
    group: list[tuple[int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        whole = END * depth + text + END
        for start in range(0, len(text) + 1, most):
            group.append((number, whole[start : start + most + depth]))
            held += len(group[-1][1])
            if held >= most:
                yield group
                group, held = [], 0
    if group:
        yield group


def _grams(units: list[tuple[int, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of depth + 1 bytes that end at each coded byte, and each unit's first and last place among them."""
    data = np.frombuffer(b"".join(u for _, u in units), np.uint8)
    found = np.zeros(max(0, len(data) - depth), np.uint64)
    for j in range(depth + 1):
        found <<= np.uint64(8)
        found |= data[j : j + len(found)]
    lengths = np.array([len(u) for _, u in units], np.int64)
    starts = np.cumsum(lengths) - lengths
    return found, starts, starts + lengths - depth


def _distinct(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with their counts, or sums of weights."""
    if weights is None:
        values = np.sort(values)
        edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.array([], int)
        return values[edges], np.diff(np.append(edges, len(values)))
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.array([], int)
    return values[edges], np.add.reduceat(weights, edges) if len(edges) else weights


def _chosen(found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of units, without those that lie across two of them."""
    return found[_within(len(found), starts, ends)]


def _within(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of ``size`` places lies in one of the units."""
    marks = np.zeros(size + 1, np.int8)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1], dtype=np.int8) > 0


def _packed(values: np.ndarray, sorted_values: bool) -> bytes:
    """64-bit numbers as eight planes of bytes, of differences if they are sorted: the high planes are nearly all zeros and compress away."""
    values = values.view(np.uint64)
    return np.ascontiguousarray((np.diff(values, prepend=np.uint64(0)) if sorted_values else values).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes, sorted_values: bool) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if sorted_values else values


def _bucket(kind: int, keys: np.ndarray, top: int, buckets: int) -> np.ndarray:
    own = (keys >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1) if kind else keys
    return (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)


def _bucket_count(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(BUCKETS[1], max(BUCKETS[0], size // BUCKET_BYTES))


def batched(docs: DataFrame, depth: int, buckets: int, id_col: str, out_col: str, text_col: str) -> DataFrame:
    """The documents in batches, and each batch's distinct strings: a written table with rows of both kinds.

    batch, ``id_col``, ``out_col`` and ``text_col`` of each document; batch, kind (0 words, 1 byte strings), bucket, keys and
    n (training counts, 0 for strings of other documents alone) in packed arrays, in rows whose kind is not null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    top = min(TOP, depth)

    def make():
        held = {"batch": 0, "bytes": 0, "words": Counter(), "ends": 0, "parts": []}

        def row_of(size: int, **given) -> dict:
            return {name: given.get(name, [None] * size) for name in (id_col, out_col, text_col, "kind", "bucket", "keys", "n")} | {"batch": [held["batch"]] * size}

        def merge() -> None:
            held["parts"] = [_distinct(np.concatenate([k for k, _ in held["parts"]]), np.concatenate([n for _, n in held["parts"]]))]

        def closed() -> Iterator[dict]:
            words = held["words"]
            keys = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in words), np.uint64, len(words))
            found = [(0, *_distinct(np.append(keys, np.uint64(END_KEY)), np.append(np.fromiter(words.values(), np.int64, len(words)), held["ends"])))]
            if held["parts"]:
                merge()
                found.append((1, *held["parts"][0]))
            for which, keys, n in found:
                at = _bucket(which, keys, top, buckets)
                order = np.argsort(at, kind="stable")
                keys, n, at = keys[order], n[order], at[order]
                edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(keys)]
                spans = list(zip(edges, edges[1:]))
                yield row_of(
                    len(spans), kind=[which] * len(spans), bucket=[int(at[i]) for i, _ in spans],
                    keys=[_packed(keys[i:j], True) for i, j in spans], n=[_packed(n[i:j], False) for i, j in spans],
                )
            held.update(batch=0, bytes=0, words=Counter(), ends=0, parts=[])

        def step(batch: pa.RecordBatch | None) -> Iterator[dict]:
            if batch is None:
                if held["batch"]:
                    yield from closed()
                return
            if not held["batch"]:
                held["batch"] = uuid.uuid4().int >> 65 | 1
            yield row_of(batch.num_rows, **{name: batch.column(i) for i, name in enumerate((id_col, out_col, text_col))})
            texts = [(t or b"").lower() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            out = batch.column(1).to_pylist()
            for own in (True, False):
                mine = [t for t, left in zip(texts, out) if left != own]
                for text in mine:
                    # words that only other rows have come with 0
                    held["words"].update(text.split() if own else dict.fromkeys(text.split(), 0))
                held["ends"] += len(mine) if own else 0
                for units in _units(mine, depth):
                    keys, n = _distinct(_chosen(*_grams(units, depth)))
                    held["parts"].append((keys, n if own else np.zeros(len(keys), np.int64)))
            if len(held["parts"]) > 8:
                merge()
            held["bytes"] += batch.nbytes
            if held["bytes"] >= BATCH_BYTES:
                yield from closed()

        return step

    schema = f"batch bigint, `{id_col}` {kind}, `{out_col}` boolean, `{text_col}` string, kind tinyint, bucket int, keys binary, n binary"
    return written(map_arrow(docs.select(id_col, out_col, text_col), make, schema, UNIT_BYTES, closing=True), "batches")


def summed(strings: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, keys, n, total and distinct (keys with a count): the sums over all batches, one row for each bucket."""

    def make():
        held: dict[tuple[int, int], list] = {}

        def step(batch: pa.RecordBatch | None):
            if batch is not None:
                for kind, bucket, keys, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    parts = held.setdefault((kind, bucket), [])
                    parts.append((_unpacked(keys, True), _unpacked(n, False).view(np.int64)))
                    if len(parts) > 16:
                        parts[:] = [_distinct(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]
                return
            for (kind, bucket), parts in sorted(held.items()):
                keys, n = _distinct(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
                yield {"kind": [kind], "bucket": [bucket], "keys": [_packed(keys, True)], "n": [_packed(n, False)], "total": [int(n.sum())], "distinct": [int((n > 0).sum())]}

        return step

    placed = strings.select("kind", "bucket", "keys", "n").repartition(buckets, "kind", "bucket")
    return written(map_arrow(placed, make, "kind tinyint, bucket int, keys binary, n binary, total bigint, distinct bigint", UNIT_BYTES, closing=True), "counts")


def code_lengths(found: DataFrame, depth: int):
    """A function from keys and counts of whole contexts to the keys' log10 probabilities, for executors.

    ``found`` has all strings' counts (see ``summed``).
    """
    top = min(TOP, depth)
    spark = found.sparkSession

    def sums():
        def step(batch: pa.RecordBatch):
            for keys, n in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for grams, counts in _chunks(_unpacked(keys, True), _unpacked(n, False).view(np.int64), top):
                    for place in range(8):
                        parents, *rest = evaluate(grams, counts, depth, top, place, False)[0].sums(top)
                        yield {"key": pa.array(parents.view(np.int64)), **dict(zip(("zeros", "ones", "weighted"), map(pa.array, rest)))}

        return step

    def nodes():
        def step(batch: pa.RecordBatch):
            level = Level(*[batch.column(i).to_numpy() for i in range(4)])
            yield {"key": pa.array(level.keys), "chance": pa.array(level.chance.astype(np.float32)), "share": pa.array(level.own_share.astype(np.float32)), **{k: pa.array(getattr(level, k)) for k in ("zeros", "ones", "weighted")}}

        return step

    total = lambda frame: frame.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    parts = total(map_arrow(found.filter("kind = 1").select("keys", "n"), sums, "key bigint, zeros double, ones double, weighted double"))
    path = new_path(spark, "nodes")
    # at most 65,536 contexts of two bytes and 255 decisions of each: a bound that no corpus passes
    map_arrow(parts, nodes, "key bigint, chance float, share float, zeros double, ones double, weighted double").write.parquet(path)
    above: list[Level] = []
    if top > 1:
        rows = total(spark.read.parquet(path).select(F.col("key").bitwiseAND(F.lit((1 << 8 * (top - 1)) - 1)).alias("key"), "zeros", "ones", "weighted")).toArrow()  # at most 256 x 255 rows
        order = np.argsort(keys := rows["key"].to_numpy())
        above = join_top(keys[order].view(np.uint64), *[rows[c].to_numpy()[order] for c in ("zeros", "ones", "weighted")], top - 2)

    def scores(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        node_keys, chance, share = _nodes(path)
        out = np.zeros(len(keys), np.float32)
        for grams, n in _chunks(keys, counts, top):
            logs = np.zeros(len(grams))
            for place in range(8):
                prefixes, bit = _decision(grams, place)
                _, mixed = evaluate(grams, n, depth, top, place, True)
                at = np.searchsorted(node_keys, _keys(grams, prefixes, top - 1).view(np.int64))
                mixed = _mixed(chance[at].astype(float), share[at].astype(float), bit, mixed)
                for d, level in zip(range(top - 2, -1, -1), above):
                    mixed = level.step(np.searchsorted(level.keys, _keys(grams, prefixes, d)), bit, mixed)
                logs += np.log10(mixed)
            out[np.searchsorted(keys, grams)] = logs
        return out

    return scores


@lru_cache(maxsize=1)
def _nodes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = read_table(path, ["key", "chance", "share"])
    order = np.argsort(keys := rows["key"].to_numpy())
    return keys[order], rows["chance"].to_numpy()[order], rows["share"].to_numpy()[order]


def valued(strings: DataFrame, found: DataFrame, buckets: int, scores) -> DataFrame:
    """batch, kind, keys and values of each batch's arrays: counts of words (64 bits), log10 probabilities of strings (32 bits)."""

    def make():
        own = {}

        def step(batch: pa.RecordBatch):
            for kind, bucket, number, keys, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if number is None:  # the bucket's sums come before its arrays
                    all_keys, counts = _unpacked(keys, True), _unpacked(n, False).view(np.int64)
                    own.update(place=(kind, bucket), keys=all_keys, values=scores(all_keys, counts) if kind else counts.astype(float))
                    continue
                if own["place"] != (kind, bucket):
                    raise ValueError(f"no sums of bucket {bucket}")
                values = own["values"][np.searchsorted(own["keys"], _unpacked(keys, True))]
                yield {"batch": [number], "kind": [kind], "keys": [keys], "vals": [values.tobytes()]}

        return step

    both = strings.select("kind", "bucket", "batch", "keys", F.lit(None).cast("binary").alias("n")).union(found.select("kind", "bucket", F.lit(None).cast("bigint"), "keys", "n"))
    placed = both.repartition(buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("batch").asc_nulls_first())
    return map_arrow(placed, make, "batch bigint, kind tinyint, keys binary, vals binary", UNIT_BYTES)


def _batch_file(folder: str, batch: int, kind: int) -> str:
    return f"{folder}/{batch % 1000:03d}/{batch:x}-{kind}.parquet"


def _keep_batch(folder: str):
    """Write one batch's words and strings, sorted, with what the model says of them."""

    def keep(rows: pa.Table) -> pa.Table:
        batch = rows["batch"][0].as_py()
        kinds, keys, values = (rows[c].to_pylist() for c in ("kind", "keys", "vals"))
        for kind, number in ((0, np.float64), (1, np.float32)):
            mine = [i for i, k in enumerate(kinds) if k == kind]
            own = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(keys[i], True) for i in mine)])
            order = np.argsort(own)
            found = np.concatenate([np.zeros(0, number), *(np.frombuffer(values[i], number) for i in mine)])
            save_table(_batch_file(folder, batch, kind), pa.table({"key": own[order].view(np.int64), "value": found[order]}))
        return pa.table({"batch": pa.array([batch], pa.int64())})

    return keep


@lru_cache(maxsize=4)
def _model_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = read_table(path, ["key", "value"])
    return rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()


keeps(__name__, lambda: (_nodes.cache_clear(), _model_of.cache_clear()))


def score(docs: DataFrame, *, modulus: int = 10, held_out: int = 0, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_coded for each row.

    base_score is the smoothed unigram model's, score the context-tree model's log10 probability of the
    text with A-Z in lower case; ``n_coded`` is the number of coded bytes, the end included, so
    -score * log2(10) / n_coded is the code length per byte in bits.  Null texts count as empty: one token,
    the end.  Rows with a null id train.  Repeated rows come back as they came; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (crc_remainder(id_col, modulus) == held_out).alias("_out"))
    buckets = _bucket_count(docs)
    batches = batched(own, depth, buckets, "_id", "_out", "_text")
    strings = batches.filter("kind IS NOT NULL")
    found = summed(strings, buckets)
    n_train, distinct = found.filter("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    folder = new_path(spark, "lengths")
    if not found.isEmpty():
        met = valued(strings, found, buckets, code_lengths(found, depth))
        met.groupBy("batch").applyInArrow(_keep_batch(folder), "batch bigint").write.format("noop").mode("overwrite").save()
    whole = log10(n_train + 0.1 * (distinct + 1))

    def make():
        def tokens(texts: list[bytes], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Tokens, known ones and the sum of log10 (count + 0.1) of each text."""
            lists = [t.split() for t in texts]
            kinds = list(set().union(*lists))
            wanted = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in kinds), np.uint64, len(kinds))
            times = values[np.searchsorted(keys, np.append(wanted, np.uint64(END_KEY)))]
            number = dict(zip(kinds, range(len(kinds))))
            sizes = np.array([len(x) + 1 for x in lists])
            at = np.full(sizes.sum(), len(kinds), np.int64)
            inner = np.ones(len(at), bool)
            inner[np.cumsum(sizes) - 1] = False
            at[inner] = np.fromiter((number[w] for x in lists for w in x), np.int64, int(inner.sum()))
            starts = np.cumsum(sizes) - sizes
            return sizes, np.add.reduceat((times[at] > 0).astype(np.int64), starts), np.add.reduceat(np.log10(times + 0.1)[at], starts)

        def lengths(grams: np.ndarray, chosen: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
            """log10 probabilities; sorted strings walk through the sorted keys once."""
            mine = grams[chosen]
            order = np.argsort(mine)
            out = np.zeros(len(grams) + 1)
            part = np.empty(len(mine))
            part[order] = values[np.searchsorted(keys, mine[order])]
            out[:-1][chosen] = part
            return out

        def scored(batch: pa.RecordBatch, number: int) -> dict:
            words, strings = (_model_of(_batch_file(folder, number, kind)) for kind in (0, 1))
            texts = [(t or b"").lower() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            scores = np.zeros(len(texts))
            for units in _units(texts, depth):
                grams, first, last = _grams(units, depth)
                logs = lengths(grams, _within(len(grams), first, last), *strings)
                np.add.at(scores, [n for n, _ in units], np.add.reduceat(logs, np.stack([first, last], 1).ravel())[::2])
            sizes, known, base = tokens(texts, *words)
            return {
                id_col: batch.column(1),
                "held_out": batch.column(3),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(texts), n_train, np.int64)),
                "base_score": pa.array(base - sizes * whole),
                "score": pa.array(scores),
                "n_coded": [len(t) + 1 for t in texts],
            }

        def step(batch: pa.RecordBatch):
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for start, stop in zip(edges, edges[1:]):
                if stop > start:
                    yield scored(batch.slice(start, stop - start), int(numbers[start]))

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    rows = batches.filter("kind IS NULL").select("batch", "_id", "_text", "_out")
    return map_arrow(rows, make, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_coded bigint", UNIT_BYTES)
