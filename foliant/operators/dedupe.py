"""Exact duplicates: size, then prefix, then digest, and which copy stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Fixed value: the digest of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
PREFIX_BYTES = 65_536


def colliding(files: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key values occur more than once.

    The counts are partial sums before their shuffle and the rows meet them in a join, which splits a hot key; a
    window would put such a key into one task.
    """
    many = files.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return files.join(many, list(keys), "left_semi")


def cascade(files: DataFrame, *, content: str = "content", prefix_bytes: int = PREFIX_BYTES, known: DataFrame | None = None) -> DataFrame:
    """id, size, prefix, sha256 of the files that share size and prefix with another.

    Sizes are compared without reading content; then prefixes of what is left; only what still collides is
    hashed whole.  ``known`` (id, sha256) are digests of earlier runs: such files still count in every
    comparison, so a new copy of a known file is found, but are not hashed again.
    """
    same_size = colliding(files.filter("size > 0").select("id", "size"), "size")
    # prefixes are read once; content is read again only for what still collides
    prefixed = written(files.join(same_size.select("id"), "id", "left_semi").select("id", "size", F.sha2(F.substring(F.col(content).cast("binary"), 1, prefix_bytes), 256).alias("prefix")), "prefixes")
    left = colliding(prefixed, "size", "prefix")
    if known is None:
        whole = files.select("id", content).join(left, "id").select("id", "size", "prefix", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    else:
        old = left.join(known.select("id", F.col("sha256").alias("_known")), "id", "left")
        new = files.join(old.filter("_known IS NULL").select("id"), "id", "left_semi").select("id", F.sha2(F.col(content).cast("binary"), 256).alias("_new"))
        whole = old.join(new, "id", "left").select("id", "size", "prefix", F.coalesce("_known", "_new").alias("sha256"))
    empty = files.filter("size = 0").select("id", "size", F.lit(EMPTY_SHA256).alias("prefix"), F.lit(EMPTY_SHA256).alias("sha256"))
    return whole.unionByName(empty)


def keep_order(priority: str = "priority", path: str = "path", id_col: str = "id") -> Column:
    """Least first: highest priority, deepest path, shortest path, least id."""
    return F.struct(-F.col(priority), -F.size(F.split(path, "/")), F.length(path), F.col(id_col))


def groups(files: DataFrame) -> DataFrame:
    """sha256, canonical_id, extra_count, wasted_bytes of every digest with two or more files."""
    best = F.min_by(F.struct("id", "size"), keep_order())
    return (
        files.filter("sha256 IS NOT NULL").groupBy("sha256")
        .agg(F.count("*").alias("n"), F.sum("size").alias("total"), best.alias("best"))
        .filter("n > 1")
        .select("sha256", F.col("best.id").alias("canonical_id"), (F.col("n") - 1).alias("extra_count"), (F.col("total") - F.col("best.size")).alias("wasted_bytes"))
    )


def quick_collisions(files: DataFrame) -> DataFrame:
    """Groups of equal name (any case), size and whole second: name, size, second, n, spare_bytes (all but one copy)."""
    keyed = files.select(F.lower(F.concat("stem", F.coalesce("ext", F.lit("")))).alias("name"), "size", F.col("mtime").cast("bigint").alias("second"))
    return keyed.groupBy("name", "size", "second").agg(F.count("*").alias("n")).filter("n > 1").withColumn("spare_bytes", (F.col("n") - 1) * F.col("size"))


def copy_groups(items: DataFrame) -> DataFrame:
    """Items with copy_group ``cg-`` and 12 digits of the digest, null for a single copy."""
    sizes = items.groupBy("sha256", "size").agg(F.count("*").alias("_n"))
    return items.join(sizes, ["sha256", "size"]).withColumn("copy_group", F.when(F.col("_n") > 1, F.concat(F.lit("cg-"), F.left("sha256", F.lit(12))))).drop("_n")


def copy_keepers(items: DataFrame) -> DataFrame:
    """copy_group, keeper: the shortest path, then the oldest, then the least in lower case."""
    return items.filter("copy_group IS NOT NULL").groupBy("copy_group").agg(F.min_by("rel", F.struct(F.length("abs"), "mtime", F.lower("abs"))).alias("keeper"))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The table with the rows of ``new`` in the place of those with equal keys (the new state, to be written beside the old)."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
