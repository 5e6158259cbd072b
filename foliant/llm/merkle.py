"""Merkle manifest of a document table: leaves, a tree for each language, the tree of their roots, proofs for all.

Leaves are numbered in each language by doc_id and cut into aligned blocks of ``fanout ** height`` rows.  A
block is a contiguous matrix of hex digests: its rows, reshaped by the fanout, are the inputs of the next
level, and the siblings of any node are slices found by index arithmetic.  A block's root is a leaf of the next
tier, which is cut the same way, so no task holds more than one block and no step grows with a language.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.numbering import numbered
from foliant.operators.tables import sized

from .common import ascii_lower, written

FANOUT = 8
#: Levels in a block: 8 ** 4 leaves are 256 KB of digests.
HEIGHT = 4
#: Hex characters of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, a colon and the value: no two lists of fields give one string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def tampered() -> Column:
    """Rows that the self-test changes."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` leaves until one node remains."""
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def hashed_rows(digests: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Digests (n, 64 bytes) of the next level: each run of ``fanout`` rows is one contiguous input; the last may be shorter."""
    flat = memoryview(np.ascontiguousarray(digests)).cast("B")
    step = fanout * HEX
    out = b"".join(sha256(flat[at : at + step]).hexdigest().encode() for at in range(0, len(flat), step))
    return np.frombuffer(out, np.uint8).reshape(-1, HEX)


def tree(leaves: np.ndarray, height: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """Levels 0 (the leaves) to ``height``."""
    out = [leaves]
    for _ in range(height):
        out.append(hashed_rows(out[-1], fanout))
    return out


def siblings(levels: list[np.ndarray], at: int, fanout: int = FANOUT) -> list[tuple[bytes, bytes]]:
    """What stands left and right of node ``at`` in its run, for each level but the last."""
    path = []
    for level in levels[:-1]:
        first = at - at % fanout
        path.append((level[first:at].tobytes(), level[at + 1 : first + fanout].tobytes()))
        at //= fanout
    return path


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _blocked(rows: DataFrame, fanout: int, height: int) -> DataFrame:
    return rows.withColumn("block", F.floor((F.col("at") - 1) / F.lit(fanout**height)).cast("bigint"))


def _levels(rows: pa.Table, fanout: int, height: int) -> list[np.ndarray]:
    """The levels of a block's rows, which stand in order."""
    return tree(_matrix(rows["digest"]), min(height, levels_of(rows["n"][0].as_py(), fanout)), fanout)


def block_roots(rows: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """grp, at (from 1), digest, n of the next tier from (grp, at, digest, n): one row for each aligned block."""

    def root(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        top = _levels(block, fanout, height)[-1]
        n = -(-block["n"][0].as_py() // fanout**height)
        return pa.table({"grp": block["grp"][:1], "at": pa.array([block["block"][0].as_py() + 1], pa.int64()), "digest": [top.tobytes().decode()], "n": pa.array([n], pa.int64())})

    made = _blocked(rows.select("grp", "at", "digest", "n"), fanout, height)
    return made.groupBy("grp", "block").applyInArrow(root, "grp string, at bigint, digest string, n bigint")


_PATH = "array<struct<l:binary,r:binary>>"
_PATH_ARROW = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))


def _with_above(rows: DataFrame, above: DataFrame, fanout: int, height: int):
    """Blocks of a tier beside the one row of the tier above that stands for each (by its ``at``)."""
    over = above.withColumn("block", F.col("at") - 1).drop("at")
    return _blocked(rows, fanout, height).groupBy("grp", "block").cogroup(over.groupBy("grp", "block"))


def paths(rows: DataFrame, above: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """grp, at, up: the siblings of each row of a tier up to the last root; ``above`` has those of its blocks (grp, at, up)."""

    def down(block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        levels = _levels(block, fanout, height)
        rest = over["up"][0].as_py()
        up = [[{"l": a, "r": b} for a, b in siblings(levels, k, fanout)] + rest for k in range(block.num_rows)]
        return pa.table({"grp": block["grp"], "at": block["at"], "up": pa.array(up, _PATH_ARROW)})

    return _with_above(rows.select("grp", "at", "digest", "n"), above.select("grp", "at", "up"), fanout, height).applyInArrow(down, f"grp string, at bigint, up {_PATH}")


def _lift(rows: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """All tiers from (grp, at, digest, n), until every group has one row."""
    tiers = [rows]
    while tiers[-1].filter("n > 1").limit(1).count():
        tiers.append(written(block_roots(tiers[-1], fanout, height), "merkle-tier"))
    return tiers


def _descend(tiers: list[DataFrame], top: DataFrame, fanout: int, height: int) -> DataFrame:
    """Paths of the second tier's rows (of the first's, if it is the only one) from those of the last tier's."""
    for tier in reversed(tiers[1:-1]):
        top = written(paths(tier, top, fanout, height), "merkle-paths")
    return top


def manifest(docs: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang and position of every document.

    ``position`` counts from 0 in the language.  A null doc_id comes first, a null lang is a group of its own
    (first of all); repeated ids stand in the order of their leaves, and rows equal in all fields have equal
    leaves, so their order changes no digest.  Missing columns of FIELDS fail; others are ignored.  No
    documents give no rows.  One document of one language is its own root and has no siblings (the digest of nothing).
    """
    changed = F.when(tampered() & F.col("text").isNotNull(), leaf(ascii_lower(F.col("text"))))
    # '-' or ':lang': a key that keeps null apart from any text, and before it
    grp = F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit("-"))
    leaves = written(docs.select("doc_id", grp.alias("grp"), leaf(F.col("text")).alias("digest"), changed.alias("other")), "merkle-leaves")
    sizes = leaves.groupBy("grp").agg(F.count("*").alias("n"))
    rows = written(numbered(leaves, ["grp"], ["doc_id", "digest"], "at").join(sized(sizes), "grp"), "merkle-rows")
    tiers = _lift(rows, fanout, height)
    # the tree of the languages: null first, then bytewise, which is the order of the keys ('-' is below ':')
    tops = tiers[-1].select(F.lit("*").alias("all"), F.col("grp").alias("of"), "digest")
    crown = numbered(tops, ["all"], ["of"], "at").select(F.col("all").alias("grp"), "at", "digest", F.lit(tops.count()).cast("bigint").alias("n"), "of")
    crown = written(crown, "merkle-crown")
    nodes = crown.drop("of")
    crowns = _lift(nodes, fanout, height)
    last = crowns[-1].first()  # one row, or none without documents
    up = _descend(crowns, crowns[-1].select("grp", "at", F.array().cast(_PATH).alias("up")), fanout, height)
    up = paths(nodes, up, fanout, height) if len(crowns) > 1 else up
    tip = crown.join(up, ["grp", "at"]).select(F.col("of").alias("grp"), F.lit(1).cast("bigint").alias("at"), "up", F.col("digest").alias("subroot"))
    tip = written(tip, "merkle-subroots")
    above = _descend(tiers, tip.select("grp", "at", "up"), fanout, height)
    return _proofs(rows, above.join(sized(tip.select("grp", "subroot")), "grp"), last["digest"] if last else "", docs.schema["doc_id"].dataType.simpleString(), fanout, height)


def _proofs(rows: DataFrame, above: DataFrame, root: str, id_type: str, fanout: int, height: int) -> DataFrame:
    def prove(block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        levels = _levels(block, fanout, height)
        rest = [(step["l"], step["r"]) for step in over["up"][0].as_py()]
        tail = b"".join(a + b for a, b in rest)
        proofs, folded = [], []
        for k, (own, other) in enumerate(zip(block["digest"].to_pylist(), block["other"].to_pylist())):
            path = siblings(levels, k, fanout)
            proofs.append(sha256(b"".join(a + b for a, b in path) + tail).hexdigest())
            folded.append(fold(fold((other or own).encode(), path), rest).decode())
        many, grp = block.num_rows, block["grp"][0].as_py()
        return pa.table({
            "doc_id": block["doc_id"], "leaf": block["digest"], "subroot": [over["subroot"][0].as_py()] * many, "root": [root] * many, "proof_sha256": proofs, "folded_root": folded,
            "verified": [f == root for f in folded], "lang": pa.array([grp[1:] if grp != "-" else None] * many, pa.string()), "position": [a - 1 for a in block["at"].to_pylist()],
        })

    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string, position bigint"
    return _with_above(rows, above, fanout, height).applyInArrow(prove, schema)
