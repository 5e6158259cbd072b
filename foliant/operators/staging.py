"""Manifests, conflicts, retention, cookies: what would be placed, kept or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, web
from . import numbering


def manifest_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """rel, problem: missing, unexpected or mismatch of (rel, size, sha256) tables; equal rows don't come."""
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, F.col("e.rel") == F.col("f.rel"), "full_outer")
    differs = (F.col("e.size") != F.col("f.size")) | (F.lower("e.sha256") != F.lower("f.sha256"))
    problem = F.when(F.col("f.rel").isNull(), "missing").when(F.col("e.rel").isNull(), "unexpected").when(differs, "mismatch")
    return both.select(F.coalesce("e.rel", "f.rel").alias("rel"), problem.alias("problem")).filter("problem IS NOT NULL")


def place_action(exists: Column, same: Column, replace: bool, on_conflict: str) -> Column:
    """copy, dup, replace, suffix or conflict."""
    clash = "replace" if replace else "suffix" if on_conflict == "suffix" else "conflict"
    return F.when(~exists, "copy").when(F.coalesce(same, F.lit(False)), "dup").otherwise(clash)


def unpack_action(reason: Column, target_kind: Column, same: Column, on_conflict: str) -> Column:
    """unsafe, new, unchanged, conflict-backup or conflict-skip."""
    return (
        F.when(reason.isNotNull(), "unsafe").when(target_kind.isNull(), "new").when(target_kind != "file", "unsafe")
        .when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("conflict-backup" if on_conflict == "backup" else "conflict-skip")
    )


def retention(status: Column, placed: Column, created: Column, cleaned: Column, now: Column, keep_days: int = 14, stale_days: int = 30) -> Column:
    """recycle: placed long enough; stale: failed or unplaced long enough; keep: anything else."""
    age = lambda at, days: F.coalesce(now >= at + F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return F.when((status == "placed") & ~F.coalesce(cleaned, F.lit(False)) & age(placed, keep_days), "recycle").when(status.isin("failed", "unplaced") & age(created, stale_days), "stale").otherwise("keep")


def versions(rows: DataFrame, taken: DataFrame, dest: str = "dest", order: str = "id", mark: str = "_v", most: int = 1000) -> DataFrame:
    """rows with ``final``: the first row of a destination that nothing holds keeps it, the others get the lowest free
    ``_v2``, ``_v3``... in their order; null beyond ``most``.

    The k-th row of a destination takes its k-th free number.  Rows beyond ``most`` of one destination get none, so
    the numbers already taken are at most so many for each.
    """
    stem, ext = paths.stem(F.col(dest)), paths.suffix(paths.file_name(F.col(dest)))
    held = taken.select(F.col(dest).alias("_held"))
    base = F.regexp_replace("_held", rf"{mark}(\d+)(\.[^./]*)?$", "$2")
    number = F.coalesce(F.nullif(F.regexp_extract("_held", rf"{mark}(\d+)(?:\.[^./]*)?$", 1), F.lit("")).try_cast("int"), F.lit(1))
    gone = held.select(base.alias(dest), number.alias("_n")).filter(F.col("_n") <= most).groupBy(dest).agg(F.array_sort(F.collect_set("_n")).alias("_taken"))
    joined = numbering.numbered(rows, [dest], [order], "_k").join(gone, dest, "left")
    n = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_k").cast("int"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    whole = F.left(F.col(dest), F.length(dest) - F.length(ext))
    named = F.when(F.col("_v") == 1, F.col(dest)).when(F.col("_v") <= most, F.concat(whole, F.lit(mark), F.col("_v").cast("string"), ext))
    return joined.withColumn("_v", n).withColumn("final", named).drop("_taken", "_k", "_v")


def staging_plan(files: DataFrame, cap: int, target: str) -> DataFrame:
    """src, role, dest: files up to the cap as they are; larger ones as a stand-in and an archive."""
    stem = paths.stem(paths.file_name(F.col("rel")))
    folder = F.concat_ws("/", F.lit(target), F.nullif(paths.parent(F.col("rel")), F.lit("")))
    row = lambda role, dest: F.struct(F.lit(role).alias("role"), dest.alias("dest"))
    one = F.array(row("file", F.concat_ws("/", F.lit(target), F.col("rel"))))
    two = F.array(row("standin", F.concat_ws("/", folder, F.concat(stem, F.lit(".jpg")))), row("zip", F.concat_ws("/", folder, F.concat(F.regexp_replace(stem, r"\s+", "_"), F.lit(".zip")))))
    return files.select("rel", F.explode(F.when(F.col("size") > cap, two).otherwise(one)).alias("r")).select(F.col("rel").alias("src"), "r.*")


def merge_register(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """sha256, first_seen, paths_seen, status: old entries keep what they know and gain new paths at the end."""
    o, f = old.alias("o"), fresh.alias("f")
    none = F.array().cast("array<string>")
    return o.join(f, F.col("o.sha256") == F.col("f.sha256"), "full_outer").select(
        F.coalesce("o.sha256", "f.sha256").alias("sha256"), F.coalesce("o.first_seen", "f.first_seen").alias("first_seen"),
        F.array_union(F.coalesce("o.paths_seen", none), F.coalesce("f.paths_seen", none)).alias("paths_seen"), F.coalesce("o.status", F.lit("new")).alias("status"),
    )


def cookie_header(cookies: DataFrame, domains: list[str], names: list[str] | None, required: list[str], now: float) -> DataFrame:
    """One row: header, count, total_length, earliest_expiry and error (a required cookie is missing or expired).

    Cookies of the domains and below, in the order of name, domain and path; a missing or non-positive expiry is
    a session's.
    """
    fits = F.lit(False)
    for d in domains:
        fits = fits | web.under_domain(F.col("domain"), F.lit(d))
    mine = cookies.filter(fits & (F.col("name").isin(*names) if names is not None else F.lit(True)))
    lasting = F.coalesce(F.col("expires") > 0, F.lit(False))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "domain", "path", F.coalesce("value", F.lit("")).alias("value")))), lambda c: F.concat_ws("=", c["name"], c["value"])), "; ")
    bad = [F.when(F.count_if(F.col("name") == r) == 0, F.lit(f"required cookie {r} missing")).when(F.max_by(lasting & (F.col("expires") < now), F.when(F.col("name") == r, F.struct("name", "domain", "path"))), F.lit(f"required cookie {r} expired")) for r in required]
    return mine.agg(joined.alias("header"), F.count("*").alias("count"), F.min(F.when(lasting, F.col("expires"))).alias("earliest_expiry"), (F.coalesce(*bad) if bad else F.lit(None).cast("string")).alias("error")).withColumn("total_length", F.length("header"))


def single_status(exists: Column, current: Column, staged: Column, expected: Column, want_new: Column, dry: Column) -> Column:
    """Compare-and-swap outcome of placing one file: missing, exists, stale, unchanged, would-place, placed."""
    return (
        F.when(want_new & exists, "exists").when(~want_new & ~exists, "missing").when(exists & (current == staged), "unchanged")
        .when(~want_new & (F.lower(current) != F.lower(expected)), "stale").when(dry, "would-place").otherwise("placed")
    )
