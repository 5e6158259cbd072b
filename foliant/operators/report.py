"""Reports over the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_stats(files: DataFrame, duplicates: DataFrame, archives: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: counts and bytes of files, duplicate groups, archives and entries, and files without a group."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("group_name").isNull()).alias("ungrouped"))
    b = duplicates.agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))
    c = archives.agg(F.count("*").alias("zips"))
    d = entries.agg(F.count("*").alias("zip_entries"))
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").join(one(c), "_one").join(one(d), "_one").drop("_one")


def source_totals(sources: DataFrame, files: DataFrame) -> DataFrame:
    """name, layout, priority, files, bytes of every source, empty ones too."""
    sums = files.groupBy("source_name").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return sources.join(sums, "source_name", "left").select("source_name", "layout", "priority", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy(F.desc("priority"), "source_name")


def duplicate_members(files: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Every member of every group with the group's numbers and whether it is the one that stays."""
    return files.select("id", "path", "sha256").join(duplicates, "sha256").withColumn("kept", F.col("id") == F.col("canonical_id"))


def top_wasted(duplicates: DataFrame, files: DataFrame, n: int = 50) -> DataFrame:
    return duplicates.join(files.select(F.col("id").alias("canonical_id"), F.col("path").alias("canonical_path")), "canonical_id").orderBy(F.desc("wasted_bytes"), "sha256").limit(n)


def size_hints(files: DataFrame, entries: DataFrame, archives: DataFrame, n: int = 100) -> DataFrame:
    """Files that have the size of an archive member: a hint that one was moved out of the other.

    The members of a size are summed up before the join, so a common size joins one row.
    """
    members = entries.groupBy("size").agg(F.count("*").alias("members"), F.min(F.struct("archive_id", "inner_path")).alias("m"))
    hit = files.select("id", "path", "size").join(members, "size").select("id", "path", "size", "members", F.col("m.archive_id").alias("archive_id"), F.col("m.inner_path").alias("inner_path"))
    return hit.join(archives, "archive_id").orderBy("id").limit(n)


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("ext", F.lit("(none)")).alias("ext")).agg(F.count("*").alias("n"))


def attachment_counts(sidecars: DataFrame) -> DataFrame:
    return sidecars.agg(F.count("parent_id").alias("attached"), (F.count("*") - F.count("parent_id")).alias("orphan"))


def compare_grid(files: DataFrame, sources: list[str], limit: int = 2000) -> DataFrame:
    """A row for each relative path, a column of sizes for each source, and whether the digests differ; the first ``limit`` paths."""
    cells = files.filter(F.col("source_name").isin(*sources)).groupBy("relpath")
    one = [F.max(F.when(F.col("source_name") == s, F.col("size"))).alias(s) for s in sources]
    return cells.agg(*one, F.count("*").alias("copies"), (F.min("sha256") != F.max("sha256")).alias("differs")).orderBy("relpath").limit(limit)


def meta_mismatch(files: DataFrame) -> DataFrame:
    """Names, sizes and seconds that occur with more than one digest."""
    keyed = files.select(F.lower(F.concat("stem", "ext")).alias("name"), "size", F.col("mtime").cast("bigint").alias("second"), "sha256")
    return keyed.groupBy("name", "size", "second").agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("digests")).filter("n > 1").withColumn("mismatch", F.col("digests") > 1)


def source_flags(files: DataFrame, duplicates: DataFrame, quick: DataFrame) -> DataFrame:
    """For each source: files in exact duplicate groups, and whether it has quick collisions."""
    exact = files.join(duplicates.select("sha256"), "sha256", "left_semi").groupBy("source_name").agg(F.count("*").alias("exact_files"))
    keyed = files.withColumn("name", F.lower(F.concat("stem", "ext"))).withColumn("second", F.col("mtime").cast("bigint"))
    loose = keyed.join(quick.select("name", "size", "second"), ["name", "size", "second"], "left_semi").groupBy("source_name").agg(F.lit(True).alias("quick"))
    every = files.select("source_name").distinct()
    return every.join(exact, "source_name", "left").join(loose, "source_name", "left").select("source_name", F.coalesce("exact_files", F.lit(0)).alias("exact_files"), F.coalesce("quick", F.lit(False)).alias("has_quick"))


def pairing_counts(pairs: DataFrame) -> DataFrame:
    """One row: archives with and without an extracted folder."""
    return pairs.agg(F.count_if("paired").alias("paired"), F.count_if(~F.col("paired")).alias("unpaired"))


def payload_totals(files: DataFrame, key: str) -> DataFrame:
    """key, members, bytes of what a pack would hold."""
    return files.groupBy(key).agg(F.count("*").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def run_tally(outcomes: DataFrame, ok: tuple[str, ...], skipped: tuple[str, ...]) -> DataFrame:
    """One row: ok, skipped and failed outcomes of a run, zeros too."""
    r = F.col("result")
    return outcomes.agg(F.count_if(r.isin(*ok)).alias("ok"), F.count_if(r.isin(*skipped)).alias("skipped"), F.count_if(~r.isin(*ok, *skipped)).alias("failed"))


def ungrouped(files: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` paths without a group."""
    return files.filter("group_name IS NULL").select("path").orderBy("path").limit(n)


def duplicate_flags(files: DataFrame, duplicates: DataFrame, quick: DataFrame) -> DataFrame:
    """id, in_hash, in_meta of every file: whether it has an exact copy, and a quick collision."""
    exact = duplicates.select("sha256", F.lit(True).alias("in_hash"))
    loose = quick.select("name", "size", "second", F.lit(True).alias("in_meta"))
    keyed = files.withColumn("name", F.lower(F.concat("stem", "ext"))).withColumn("second", F.col("mtime").cast("bigint"))
    return keyed.join(exact, "sha256", "left").join(loose, ["name", "size", "second"], "left").select("id", F.coalesce("in_hash", F.lit(False)).alias("in_hash"), F.coalesce("in_meta", F.lit(False)).alias("in_meta"))


def overview(files: DataFrame, duplicates: DataFrame, quick: DataFrame, scanned, now, duration: float) -> DataFrame:
    """One row: files, bytes, bytes to spare by digest and by name, size and time, and whether the scan is older than a minute and than it took."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    b = duplicates.agg(F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("deep_spare"))
    c = quick.agg(F.coalesce(F.sum("spare_bytes"), F.lit(0)).alias("quick_spare"))
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(scanned).cast("timestamp"))
    return one(a).join(one(b), "_one").join(one(c), "_one").drop("_one").withColumn("stale", age > max(60.0, duration))


def pick_columns(preferred: DataFrame, every: DataFrame, key: str, n: int) -> DataFrame:
    """number, key: the preferred names first, then the others, each once and ``n`` at most; both have an order column ``at``."""
    both = preferred.select(key, F.struct(F.lit(0).alias("tier"), "at").alias("rank")).unionByName(every.select(key, F.struct(F.lit(1).alias("tier"), "at").alias("rank")))
    first = both.groupBy(key).agg(F.min("rank").alias("rank"))
    picked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", key))), 1, n), lambda x: x[key])
    return first.orderBy("rank", key).limit(n).agg(picked.alias("p")).select(F.posexplode("p").alias("number", key))


def register_order(entries: DataFrame, path: str = "path") -> DataFrame:
    return entries.orderBy(F.lower(path), path)
