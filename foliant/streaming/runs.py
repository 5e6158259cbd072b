"""Runs of a stream over what has arrived: each takes up at the checkpoint of the one before and ends."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stream = Callable[[DataFrame], DataFrame]


def arrive(rows: DataFrame, base: str) -> None:
    """Add rows to the folder that the stream under ``base`` reads."""
    rows.write.mode("append").parquet(f"{base}/in")


def advance(spark: SparkSession, base: str, make: Stream, mode: str = "append") -> list[dict]:
    """Run ``make`` over what has arrived since the last run; its rows go to ``base``/out once, its progress comes back.

    The file sink writes each batch once, whatever is repeated: the names of its files are in a log.
    """
    schema = spark.read.parquet(f"{base}/in").schema
    query = make(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return [_plain(p) for p in query.recentProgress]


def advance_each(spark: SparkSession, base: str, make: Stream, commit: Callable[[DataFrame, int], None], mode: str = "update") -> list[dict]:
    """Like ``advance``, but each batch goes to ``commit`` with its number, perhaps more than once."""
    schema = spark.read.parquet(f"{base}/in").schema
    query = make(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(commit).start()
    query.awaitTermination()
    return [_plain(p) for p in query.recentProgress]


def _plain(progress) -> dict:
    """batch, rows read, and rows that the state holds, dropped in this batch and refused as too late."""
    states = progress["stateOperators"]
    return {"batch": progress["batchId"], "rows": progress["numInputRows"], "held": sum(s["numRowsTotal"] for s in states), "dropped": sum(s["numRowsRemoved"] for s in states), "late": sum(s["numRowsDroppedByWatermark"] for s in states)}


def slices(rows: DataFrame, at: str, count: int) -> list[DataFrame]:
    """``rows`` cut into ``count`` ranges of equal length of the time ``at``; rows without a time are in none."""
    first, last = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    if first is None:
        return []
    step = (last - first) // count + 1
    bound = lambda n: F.timestamp_micros(F.lit(first + n * step))
    return [rows.filter((F.col(at) >= bound(n)) & (F.col(at) < bound(n + 1))) for n in range(count)]


def marker(rows: DataFrame, at: str, when: datetime) -> DataFrame:
    """One row of nulls at a later time: it moves the watermark on, so that what is open before it is finished."""
    spark = rows.sparkSession
    return spark.range(1).select(*[(F.lit(when) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
