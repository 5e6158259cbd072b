"""Jobs as keyed state with timers: what events and the passing of time make of each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import shared_dir
from . import runs

#: Statuses that an event may give; anything else (``new``) only opens a job.
OUTCOMES = ("placed", "failed", "unplaced", "cleaned")
TRANSITIONS = "job string, at timestamp, status string"
#: Stands for a null job, whose rows move the watermark and nothing else (a filter would be pushed below the watermark).
_NOBODY = "\0"
_DAY = 86_400_000
#: Keys of the state: each holds the jobs of one remainder of their hash, and must not change between runs of one stream.
BUCKETS = 512
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobLife(StatefulProcessor):
    """Transitions of the jobs of one bucket from their events (job, at, status), in their order.

    The first event opens a job (``new``).  A placed job is due for recycling ``keep_days`` later, a failed or unplaced
    one is stale ``stale_days`` after it was opened; another outcome moves the timer, ``cleaned`` ends the job.  What
    the timer says is final: the state goes, and a later event of the same name opens a new job.

    State is read and written once for a bucket and batch, not for a job: its open jobs are one value, and its timer is
    that of the job that is due first.
    """

    def __init__(self, keep_days: int, stale_days: int):
        self.keep, self.stale = keep_days * _DAY, stale_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("lives", "jobs string, timer bigint")

    def _open(self) -> tuple[dict[str, list], int | None]:
        """The open jobs of the bucket, each with when it was opened, its status and when it is due; and the timer that is set."""
        if not self.life.exists():
            return {}, None
        text, timer = self.life.get()
        return json.loads(text), timer

    def _keep(self, lives: dict[str, list], timer: int | None) -> None:
        due = min((d for _, _, d in lives.values() if d is not None), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if lives:
            self.life.update((json.dumps(lives), due))
        else:
            self.life.clear()

    @staticmethod
    def _end(status: str) -> str:
        return "recycle" if status == "placed" else "stale"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events[events["job"] != _NOBODY].sort_values(["at", "status"])
        lives, timer = self._open()
        made = []
        micros = events["at"].astype("datetime64[us]").astype("int64")
        for job, at, found in zip(events["job"], micros, events["status"]):
            now = at // 1000
            opened, status, due = lives.get(job, (None, None, None))
            if due is not None and due <= now:  # the time came between two events of one batch
                made.append((job, due * 1000, self._end(status)))
                opened, status, due = None, None, None
            if opened is None:
                opened, status = now, "new"
                made.append((job, at, "new"))
            if found in OUTCOMES:
                status = found
                made.append((job, at, status))
                due = now + self.keep if status == "placed" else opened + self.stale if status != "cleaned" else None
            if status == "cleaned":
                lives.pop(job, None)
            else:
                lives[job] = [opened, status, due]
        self._keep(lives, timer)
        yield self._table(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All jobs of the bucket that are due by now; the timer that went off is gone."""
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        lives, _ = self._open()
        over = {job: life for job, life in lives.items() if life[2] is not None and life[2] <= passed}
        self._keep({job: life for job, life in lives.items() if job not in over}, None)
        yield self._table([(job, due * 1000, self._end(status)) for job, (_, status, due) in over.items()])

    @staticmethod
    def _table(made: list) -> pd.DataFrame:
        jobs, at, status = zip(*made) if made else ((), (), ())
        return pd.DataFrame({"job": pd.Series(jobs, dtype=object), "at": pd.Series(at, dtype="int64").astype("datetime64[us]").astype("datetime64[ns]"), "status": pd.Series(status, dtype=object)})

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, *, keep_days: int = 14, stale_days: int = 30, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """job, at, status: every transition of the jobs in a stream of events (job, at, status), timers included.

    Jobs are keyed by bucket, so that a batch costs a few state calls for each bucket, however many jobs there are.
    Rows of null job or time are left out; timers go off when the newest time, less ``delay``, has passed them.
    """
    sound = events.withColumn("job", F.coalesce("job", F.lit(_NOBODY))).withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(buckets))).filter("at IS NOT NULL").withWatermark("at", delay)
    return sound.groupBy("bucket").transformWithStateInPandas(JobLife(keep_days, stale_days), TRANSITIONS, "Append", "EventTime")


def run_jobs(spark: SparkSession, events: DataFrame, *, keep_days: int = 14, stale_days: int = 30, arrivals: int = 3) -> DataFrame:
    """Transitions of a table of events that arrives in order of time; timers up to the last event's time go off.

    Each arrival is a run of its own, and its batches are committed by their numbers: a repeated one writes over itself.
    """
    base = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    make = lambda rows: job_stream(rows, keep_days=keep_days, stale_days=stale_days)
    try:
        last = events.agg(F.max("at")).first()[0]
        for part in runs.slices(events, "at", arrivals):
            runs.arrive(part, base)
            runs.advance_each(spark, base, make, commit, "append")
        if last is None:
            return spark.createDataFrame([], TRANSITIONS)
        runs.arrive(runs.marker(events, "at", last + timedelta(hours=1)), base)
        runs.advance_each(spark, base, make, commit, "append")
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(TRANSITIONS).parquet(f"{base}/out/batch=*")
