"""Near duplicates of embeddings: lattice hashing with E8, neighbouring cells, exact cosine.

A table projects unit vectors to eight dimensions at random and decodes them to the nearest point of the E8
lattice, the densest packing there: near vectors fall into one cell or into neighbouring ones.  Each vector has a
home cell in each table and probes the next-nearest cells; two vectors meet where one is at home in a cell that
the other has or probes, and their cosine decides.

Copies are one vector with a weight.  Vectors within half the angle of the limit of a common pivot are a ball:
all of them link by the triangle inequality and nothing among them is compared, so tight groups cost what their
size is.  What meets between balls is compared in blocks of bounded size, in which links are counted,
not listed; a pair that meets more than once counts where it meets first.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.tables import sized

from .common import map_arrow, written
from .graph import components

#: Tables, cells probed besides the home cell, and the scale of a unit vector's projection.  Measured on pairs of
#: cosine 0.98 exactly: 0.99 of them meet; at 0.99 nearly all.  Vectors at random meet with probability 2e-4.
TABLES, PROBES, SCALE = 4, 3, 3.5
LIMIT = 0.98
#: Vectors of a block; a task compares two blocks.
BLOCK = 1024
#: Rounding that the triangle inequality must survive.
SLACK = 1e-9


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 neighbours of a point of E8: two coordinates of 1 either way, or all of one half with an even count of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(out, pairs):
        row[i], row[j] = a, b
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([out, signs[(signs < 0).sum(1) % 2 == 0] / 2])


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and where the sum is odd move the coordinate that costs least."""
    out = np.round(y)
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    off = y[odd] - out[odd]
    worst = np.abs(off).argmax(1)
    out[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return out


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (n, 8): of the even integer points and of those shifted by one half the nearer."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1))[:, None], whole, half)


@cache
def projection(table: int, dims: int) -> np.ndarray:
    """Orthogonal directions (dims, 8), scaled so that distances keep their size on average."""
    made = np.random.RandomState(1_000_003 * table + dims).normal(size=(max(dims, 8), 8))
    return np.linalg.qr(made)[0][:dims] * np.sqrt(max(dims, 8) / 8)


def cells(units: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cell keys (n, TABLES, 1 + PROBES): the home cell and the next-nearest ones, apart for each label and table."""
    out = np.zeros((len(units), TABLES, 1 + PROBES), np.int64)
    near = minimal_vectors()
    for t in range(TABLES):
        y = units @ projection(t, units.shape[1]) * SCALE
        home = decode(y)
        # the neighbour by v is nearer the larger the offset's part along v is; v's length is the same for all
        best = np.argsort(-((y - home) @ near.T), axis=1, kind="stable")[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + near[best]], 1)
        out[:, t] = _key(points, label, t)
    return out


def _key(points: np.ndarray, label: np.ndarray, table: int) -> np.ndarray:
    mixed = np.broadcast_to((label * np.int64(TABLES) + table).view(np.uint64)[:, None], points.shape[:2]).copy()
    for k in range(8):
        mixed = (mixed ^ np.round(points[:, :, k] * 2).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width scaled to length 1, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    # squares of very large or very small components must not leave the doubles
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def index(classes: DataFrame) -> DataFrame:
    """Distinct vectors (id, tag, label, dims, embedding and others) with their cell keys in ``cells``."""
    names = classes.columns
    named = classes.withColumn("_key", F.xxhash64("label", "dims"))  # vectors of other dimensions are apart like other labels

    def make():
        def step(part):
            width = part["dims"].to_numpy()
            for d in np.unique(width):
                rows = part.take(pa.array(np.flatnonzero(width == d)))
                at = cells(units(rows["embedding"], d), rows["_key"].to_numpy())
                yield {c: rows[c] for c in names} | {"cells": pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), TABLES * (1 + PROBES)).cast(pa.list_(pa.int64()))}

        return step

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return map_arrow(named, make, f"{fields}, cells array<bigint>")


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda m, n: m.cast("double") * n), F.lit(0.0), lambda s, m: s + m)
    found = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(~F.isnan(found), found)


def with_balls(indexed: DataFrame) -> DataFrame:
    """``indexed`` with ball_id, ball_tag: the pivot of the vectors that surely link with each other, else the vector itself.

    A home cell of the first table has one pivot, its least vector; a ball is what lies within half the limit's
    angle of it.
    """
    home = F.col("cells")[0].alias("home")
    pivots = indexed.groupBy(home, "dims").agg(F.min(F.struct("id", "tag", "embedding")).alias("pivot"), F.count("*").alias("many")).filter("many > 1").drop("many")
    half = float(np.sqrt((1 + LIMIT) / 2)) + SLACK
    near = indexed.select("id", "tag", "dims", "embedding", home).join(sized(pivots, 10_000), ["home", "dims"]).filter(_cosine("embedding", "pivot.embedding") >= half)
    inside = written(near.select("id", "tag", F.col("pivot.id").alias("ball_id"), F.col("pivot.tag").alias("ball_tag")), "lattice-balls")
    own = lambda c: F.coalesce(f"ball_{c}", c).alias(f"ball_{c}")
    return indexed.join(sized(inside), ["id", "tag"], "left").select(*indexed.columns, own("id"), own("tag"))


def meetings(members: DataFrame) -> DataFrame:
    """cell, id, tag, ball of the vectors in those cells where somebody is at home and two balls meet."""
    each = members.select("id", "tag", "ball_id", "ball_tag", F.posexplode("cells").alias("n", "cell"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("ball_id", "ball_tag") for n, f in (("low", F.min), ("high", F.max))]
    alive = each.groupBy("cell").agg(*ends, F.max(F.col("n") % (1 + PROBES) == 0).alias("home"))
    alive = written(alive.filter("home AND (low_ball_id <> high_ball_id OR low_ball_tag <> high_ball_tag)").select("cell"), "lattice-cells")
    return each.join(sized(alive), "cell").select("cell", "id", "tag", F.struct("ball_id", "ball_tag").alias("ball"))


def blocks(met: DataFrame) -> DataFrame:
    """id, tag, cell, one, two, side: the block pairs (one, two) of each cell that a vector takes part in.

    A ball of more than BLOCK vectors in a cell has blocks of its own, never paired with each other.
    """
    sizes = met.groupBy("cell", "ball").agg(F.count("*").alias("many"))
    big = sizes.filter(F.col("many") > BLOCK)
    rest = sizes.filter(F.col("many") <= BLOCK).groupBy("cell").agg(F.sum("many").alias("left"))
    spread = lambda many: F.pmod(F.xxhash64("id", "tag"), F.ceil(F.col(many) / BLOCK))
    placed = met.join(sized(big), ["cell", "ball"], "left").join(sized(rest), "cell", "left")
    own = F.when(F.col("many").isNotNull(), F.col("ball"))
    block = F.struct(own.alias("own"), F.when(F.col("many").isNotNull(), spread("many")).otherwise(spread("left")).alias("part"))
    placed = placed.select("id", "tag", "cell", block.alias("block"))
    known = placed.select("cell", "block").distinct()
    other = known.select("cell", F.col("block").alias("two"))
    pairs = known.withColumnRenamed("block", "one").join(other, "cell").filter("one <= two AND (one.own IS NULL OR two.own IS NULL OR one.own <> two.own)")
    left = placed.withColumnRenamed("block", "one").join(pairs, ["cell", "one"]).withColumn("side", F.lit(0))
    right = placed.withColumnRenamed("block", "two").join(pairs.filter("one <> two"), ["cell", "two"]).withColumn("side", F.lit(1))
    return left.unionByName(right)


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell (n,) in which rows of cells (n, TABLES, 1 + PROBES) meet, by table, a's home before b's; and whether there is one."""
    cell, found = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for t in range(TABLES):
        for home, other in ((a[:, t, 0], b[:, t]), (b[:, t, 0], a[:, t])):
            here = ~found & (other == home[:, None]).any(1)
            cell[here] = home[here]
            found |= here
    return cell, found


def _compare(rows: pa.Table) -> pa.Table:
    """Links of one pair of blocks: id, tag, n (weight of the vectors linked here), root (a vector of the same component)."""
    rows = rows.sort_by([("id", "ascending"), ("tag", "ascending")])
    x = units(rows["embedding"].combine_chunks(), rows["dims"][0].as_py())
    at = np.stack(rows["cells"].to_numpy()).reshape(-1, TABLES, 1 + PROBES)
    ids, weight, side, cell = (rows[c].to_numpy() for c in ("id", "weight", "side", "cell"))
    _, ball = np.unique(np.stack([rows["ball_id"].to_numpy(), rows["ball_tag"].to_numpy()]), axis=1, return_inverse=True)
    ball = ball.ravel()
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    right = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(ids))
    same = len(right) == len(ids)
    for start in range(0, len(ids), 256):
        left = np.arange(start, min(start + 256, len(ids)))
        left = left if same else left[side[left] == 0]
        near = (x[left] @ x[right].T >= LIMIT) & (ball[left][:, None] != ball[right][None])
        if same:
            near &= left[:, None] < right[None]
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        where, met = _meet(at[i], at[j])
        mine = met & (where == cell[i])
        i, j = i[mine], j[mine]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        ends.append((i, j))
    i, j = (np.concatenate(e) for e in zip(*ends)) if ends else (np.zeros(0, int),) * 2
    while len(i):
        low = np.minimum(root[i], root[j])
        if (low == root[i]).all() and (low == root[j]).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
    hit = np.flatnonzero(links)
    return pa.table({"id": ids[hit], "tag": rows["tag"].to_numpy()[hit], "n": links[hit], "root": ids[root[hit]]})


def links(members: DataFrame) -> DataFrame:
    """id, tag, n, root from the comparison of all blocks."""
    met = written(meetings(members), "lattice-meetings")
    work = written(blocks(met), "lattice-blocks")
    wide = work.join(members, ["id", "tag"])
    return wide.select("id", "tag", "cell", "one", "two", "side", "weight", "dims", "embedding", "cells", "ball_id", "ball_tag").groupBy("cell", "one", "two").applyInArrow(_compare, "id bigint, tag bigint, n bigint, root bigint")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label).

    A row links with rows of its label and dimension at a cosine of LIMIT or more.  Null labels, null or empty
    or zero vectors and vectors with null or non-finite components link with nothing.  Rows that repeat an id count
    as vectors of their own but are one node of the components.  A row of null id links with nothing and has no
    component (kept: false).  No rows give none; other columns are ignored.
    """
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    vector = F.col("embedding").cast(kind)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # 128 bits tell vectors apart; zeros of either sign are equal
    hashed = lambda seed: F.when(F.col("usable"), F.xxhash64(F.lit(seed), F.transform(vector, lambda x: x + F.lit(0).cast("float"))))
    base = rows.select("vec_id", "label", "embedding", usable.alias("usable")).withColumn("h1", hashed(1)).withColumn("h2", hashed(2))
    key = ["label", "h1", "h2"]
    classes = base.filter("usable").groupBy(*key).agg(F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("weight"), F.any_value(vector).alias("embedding"))
    indexed = written(index(classes.withColumn("tag", F.xxhash64("h1", "h2", "label")).withColumn("dims", F.size("embedding"))), "lattice-index")
    members = with_balls(indexed)
    found = written(links(members), "lattice-links")
    ball = ["ball_id", "ball_tag"]
    held = members.groupBy(*ball).agg(F.sum("weight").alias("held")).filter(F.col("held") > 1)
    crossing = found.groupBy("id", "tag").agg(F.sum("n").alias("n"))
    counted = members.select(*key, "id", "tag", *ball).join(held, ball, "left").join(crossing, ["id", "tag"], "left")
    counted = counted.select(*key, "id", (F.coalesce("held", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    groups = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")).union(members.select("id", "ball_id")))
    done = counted.join(groups, F.col("id") == F.col("node"), "left").select(*key, "n_links", F.coalesce("component", "id").alias("component_id"))
    out = base.select("vec_id", *key).join(done, key, "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("bigint"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
