"""Tables that several steps of one plan read: written once to the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a table of a few numbers is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on one machine without the setting one beside the warehouse.

    On a cluster the setting is needed: a folder that only one machine sees would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``limit`` rows, by count; else as it is, for a shuffled join."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def written(frame: DataFrame, kind: str) -> DataFrame:
    """``frame`` written and read again: what follows repeats none of its work, and a lost executor costs nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
