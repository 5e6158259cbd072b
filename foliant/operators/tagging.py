"""Batches, bursts and the two-phase tag plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, sniff
from . import numbering
from .tables import written


def bursts(items: DataFrame, *, seconds: float = 300, parent: str = "parent_rel", at: str = "mtime", order: str = "rel") -> DataFrame:
    """batch and burst size for each item: ``burst:<folder>:<n>`` for runs of two or more whose gaps are at most
    ``seconds``, else ``dir:<folder>``; runs of two or more are numbered from 0 in each folder.

    A folder's items are sorted in one task, with spilling; folders are the unit of the order itself.
    """
    flow = W.partitionBy(parent).orderBy(at, order)
    gap = F.col(at) - F.lag(at).over(flow)
    cut = items.withColumn("_new", F.when(gap.isNull() | (gap > seconds), 1).otherwise(0))
    runs = cut.withColumn("_run", F.sum("_new").over(flow.rowsBetween(W.unboundedPreceding, 0)))
    sizes = runs.groupBy(parent, "_run").agg(F.count("*").alias("burst_size"))
    real = sizes.filter("burst_size > 1").withColumn("_index", F.row_number().over(W.partitionBy(parent).orderBy("_run")) - 1)
    key = F.when(F.col(parent) == "", ".").otherwise(F.col(parent))
    return (
        runs.join(sizes, [parent, "_run"]).join(real.select(parent, "_run", "_index"), [parent, "_run"], "left")
        .withColumn("batch", F.when(F.col("_index").isNull(), F.concat(F.lit("dir:"), key)).otherwise(F.concat_ws(":", F.lit("burst"), key, F.col("_index"))))
        .drop("_new", "_run", "_index")
    )


def batches(items: DataFrame, *, seconds: float = 300) -> DataFrame:
    """batch of each item (rel, parent_rel, stem, ext, mtime): an archive and what shares its stem or lies in a
    folder of its name is one ``zip:`` batch; the rest falls into bursts."""
    slash = F.when(F.col("parent_rel") == "", F.col("stem")).otherwise(F.concat_ws("/", "parent_rel", "stem"))
    zips = items.filter(F.lower("ext").isin(*sniff.ARCHIVES)).groupBy(F.col("parent_rel").alias("_p"), F.lower("stem").alias("_s")).agg(F.min_by(slash, F.lower("rel")).alias("_zip"))
    beside = items.join(zips, (F.col("parent_rel") == F.col("_p")) & (F.lower("stem") == F.col("_s")), "left").drop("_p", "_s")
    roots = zips.select(F.lower("_zip").alias("_root"), F.col("_zip").alias("_home"))
    up = F.explode_outer(F.transform(F.sequence(F.lit(1), F.size(F.split("parent_rel", "/"))), lambda n: F.array_join(F.slice(F.split(F.lower("parent_rel"), "/"), 1, n), "/")))
    inside = items.filter("parent_rel <> ''").select("rel", up.alias("_root")).join(roots, "_root").groupBy("rel").agg(F.max_by("_home", F.length("_root")).alias("_inside"))
    found = beside.join(inside, "rel", "left").withColumn("_zip", F.coalesce("_zip", "_inside")).drop("_inside")
    free = bursts(found.filter("_zip IS NULL"), seconds=seconds).drop("burst_size", "_zip")
    return found.filter("_zip IS NOT NULL").withColumn("batch", F.concat(F.lit("zip:"), F.col("_zip"))).drop("_zip").unionByName(free)


def batch_votes(items: DataFrame, target: str = "bin") -> DataFrame:
    """batch, members, approved: all members sure, all with the same known bin."""
    sure = (F.col("confidence") == "high") & F.col(target).isNotNull()
    return items.groupBy("batch").agg(F.count("*").alias("members"), (F.bool_and(F.coalesce(sure, F.lit(False))) & (F.min(target) == F.max(target))).alias("approved"))


def plan(items: DataFrame, destination: str) -> DataFrame:
    """rel, proposal (move, recycle, review), reason and dst for each item (rel, abs, bin, confidence, batch, copy_group, mtime).

    Items of approved batches move; extra copies recycle if their keeper moves; equal destinations (any case)
    send all of them to review, and so does a place that is already right.
    """
    git = paths.in_folder_named(F.col("abs"), ".git")
    judged = items.withColumn("confidence", F.when(git, "refused").otherwise(F.col("confidence"))).withColumn("bin", F.when(F.col("bin").isin(*sniff.BINS), F.col("bin")))
    # votes, keepers and rows read it: what it took to judge the items is done once
    judged = written(judged, "judged")
    voted = judged.join(batch_votes(judged), "batch")
    keepers = judged.filter("copy_group IS NOT NULL").groupBy("copy_group").agg(F.min_by("rel", F.struct(F.length("abs"), "mtime", F.lower("abs"))).alias("keeper"))
    own = voted.join(keepers, "copy_group", "left")
    dst = F.concat_ws("/", F.lit(destination), F.col("bin"), paths.file_name(F.col("abs")))
    single = F.when(git, "refused: path under .git").when(F.col("confidence") != "high", "not high confidence").otherwise("unknown bin")
    held = F.when(F.col("members") == 1, single).otherwise("batch held: not all members are sure of the same bin")
    first = own.withColumn("dst", F.when(F.col("approved"), dst)).withColumn(
        "proposal",
        F.when(~F.col("approved"), "review").when(F.col("keeper").isNotNull() & (F.col("keeper") != F.col("rel")), "recycle").when(F.lower("abs") == F.lower("dst"), "review").otherwise("move"),
    ).withColumn("reason", F.when(~F.col("approved"), held).when(F.col("proposal") == "review", "already in place"))
    first = written(first, "proposals")
    crowded = first.filter("proposal = 'move'").groupBy(F.lower("dst").alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1")
    second = first.join(crowded, F.lower("dst") == F.col("_key"), "left").withColumn("_clash", (F.col("proposal") == "move") & F.col("_n").isNotNull())
    second = second.withColumn("reason", F.when(F.col("_clash"), "destination collision in plan").otherwise(F.col("reason"))).withColumn("proposal", F.when(F.col("_clash"), "review").otherwise(F.col("proposal"))).drop("_key", "_n", "_clash")
    moving = second.filter("proposal = 'move'").select(F.col("rel").alias("keeper"), F.lit(True).alias("_moves"))
    last = second.join(moving, "keeper", "left").withColumn("_left", (F.col("proposal") == "recycle") & F.col("_moves").isNull())
    return last.select(
        "rel", F.when(F.col("_left"), "review").otherwise(F.col("proposal")).alias("proposal"),
        F.when(F.col("_left"), "extra copy; original was not moved").otherwise(F.col("reason")).alias("reason"), "dst",
    )


def numbered_actions(planned: DataFrame, kinds: tuple[str, ...] = ("move", "recycle")) -> DataFrame:
    """id, op, rel, dst of moves and recyclings, each numbered in the order of rel (``move-0001``).

    Each kind is numbered over its sorted ranges; rows of equal rel are in no defined order.
    """
    ops = numbering.numbered(planned.filter(F.col("proposal").isin(*kinds)), ["proposal"], ["rel"], "_number")
    number = F.col("_number").cast("string")
    return ops.select(
        F.concat("proposal", F.lit("-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("id"), F.col("proposal").alias("op"), "rel", "dst"
    )


def eligible(level_bin: Column, confidence: Column, path: Column) -> Column:
    """struct<ok, reason> of one item by itself."""
    answer = lambda ok, why: F.struct(F.lit(ok).alias("ok"), F.lit(why).alias("reason"))
    return sniff.first_of(
        [(paths.in_folder_named(path, ".git"), answer(False, "refused: path under .git")), (confidence != "high", answer(False, "not high confidence")), (~level_bin.isin(*sniff.BINS), answer(False, "unknown bin"))],
        answer(True, ""),
    )


def action_rows(planned: DataFrame) -> DataFrame:
    """id, op, src, dst of a plan's actions: the folders to make, then moves and recyclings, each kind numbered."""
    folders = planned.filter("proposal = 'move'").select(paths.parent(F.col("dst")).alias("rel")).distinct().select("rel", F.lit("mkdir").alias("proposal"), F.col("rel").alias("dst"))
    numbered = numbered_actions(folders.unionByName(planned.select("rel", "proposal", "dst")), ("mkdir", "move", "recycle"))
    return numbered.select("id", "op", F.when(F.col("op") != "mkdir", F.col("rel")).alias("src"), F.when(F.col("op") != "recycle", F.col("dst")).alias("dst"))
