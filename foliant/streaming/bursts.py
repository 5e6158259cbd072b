"""Structured Streaming forms of bursts and of the digest index, with state that does not grow with the stream."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir
from . import runs


def burst_stream(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """parent_rel, first_second, members of each burst of two or more; gaps of exactly ``gap`` still join.

    Late rows count up to ``delay`` behind the newest; then a burst is final: it is appended and its state goes.
    """
    marked = events.withWatermark("at", delay)
    found = marked.groupBy("parent_rel", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("members"), F.min("at").alias("first"))
    return found.filter("members > 1").select("parent_rel", F.unix_seconds("first").alias("first_second"), "members")


def index_changes(files: DataFrame) -> DataFrame:
    """sha256, first_id, copies of the digests in one batch of files: what the index gains by it."""
    return files.groupBy("sha256").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


#: Change sets after which the index is written anew as one.
COMPACT = 8


class DigestIndex:
    """A table of digests that grows by change sets, one for each batch, which add up: no state is held by the stream.

    A repeated batch writes the same rows over its own.  ``base=<n>`` holds everything up to batch n, ``batch=<n>``
    one change set; a base that was not finished has no marker of success and does not count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch: DataFrame, number: int) -> None:
        index_changes(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if number % COMPACT == COMPACT - 1:
            self.read(number).write.mode("overwrite").parquet(f"{self.path}/base={number}")

    def _numbers(self, kind: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        paths = [s.getPath() for s in system.listStatus(folder)]
        done = [p.getName() for p in paths if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{kind}="))

    def read(self, upto: int | None = None) -> DataFrame:
        """sha256, first_id, copies after batch ``upto`` (all): the newest base and the change sets after it."""
        within = lambda n: upto is None or n <= upto
        # a base of the batch that is being repeated is not built upon
        bases = [n for n in self._numbers("base") if upto is None or n < upto]
        start = bases[-1] if bases else -1
        parts = [f"{self.path}/base={start}"] * bool(bases) + [f"{self.path}/batch={n}" for n in self._numbers("batch") if n > start and within(n)]
        schema = "sha256 string, first_id bigint, copies bigint"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy("sha256").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_bursts(spark: SparkSession, path: str, gap: str, arrivals: int = 4) -> DataFrame:
    """Bursts of a table of events that arrives in order of time, each part in a run of its own from the checkpoint of the last."""
    events = spark.read.parquet(path).select(F.col("user_id").cast("string").alias("parent_rel"), F.col("ts").cast("timestamp").alias("at"))
    base, make = _base(spark), lambda rows: burst_stream(rows, gap)
    for part in runs.slices(events, "at", arrivals):
        runs.arrive(part, base)
        runs.advance(spark, base, make)
    last = events.agg(F.max("at")).first()[0]
    if last is None:
        return burst_stream(events, gap)
    runs.arrive(runs.marker(events, "at", last + timedelta(days=1)), base)
    runs.advance(spark, base, make)
    return spark.read.parquet(f"{base}/out")


def run_index(spark: SparkSession, path: str, arrivals: int = 4) -> DataFrame:
    """The digest index of documents that arrive in parts by id."""
    docs = spark.read.parquet(path).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    base = _base(spark)
    index = DigestIndex(spark, f"{base}/index")
    for n in range(arrivals):
        runs.arrive(docs.filter(F.pmod(F.hash("id"), F.lit(arrivals)) == n), base)
        runs.advance_each(spark, base, lambda rows: rows, index.commit)
    return index.read()
