"""Streams: bounded state, restarts, retries, timers."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.streaming import bursts, feed_source, jobs, runs

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_burst_state_falls_and_a_restart_changes_nothing(spark, tmp_path):
    """Every arrival is a run of its own; state holds the open bursts only, however many there have been."""
    make = lambda rows: bursts.burst_stream(rows, "5 minutes", "1 minute")
    base, held, dropped = str(tmp_path / "s"), [], []
    for hour in range(4):
        rows = [(f"p{k}", at(hour * 60 + k + n)) for k in range(20) for n in range(3)]
        runs.arrive(spark.createDataFrame(rows, "parent_rel string, at timestamp"), base)
        progress = runs.advance(spark, base, make)
        held.append(progress[-1]["held"])
        dropped.append(sum(p["dropped"] for p in progress))
    assert max(held) <= 20 and min(dropped[1:]) > 0
    late = spark.createDataFrame([("late", at(1)), ("late", at(2))], "parent_rel string, at timestamp")
    runs.arrive(late, base)
    assert sum(p["late"] for p in runs.advance(spark, base, make)) == 2
    runs.arrive(runs.marker(late, "at", at(600)), base)
    last = runs.advance(spark, base, make)
    assert last[-1]["held"] <= 1
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == got.distinct().count() == 80 and {r.members for r in got.collect()} == {3}
    # nothing new: nothing happens
    assert all(p["rows"] == 0 for p in runs.advance(spark, base, make)) and spark.read.parquet(f"{base}/out").count() == 80


def test_index_adds_up_and_repeats_are_harmless(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bursts, "COMPACT", 2)
    index = bursts.DigestIndex(spark, str(tmp_path / "index"))
    assert index.read().count() == 0
    batches = [[(3, "a"), (1, "b")], [(2, "a"), (2, "c")], [(9, "a"), (0, "c")], [(5, None)]]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "id bigint, sha256 string")
        index.commit(frame, n)
        index.commit(frame, n)
    assert sorted((tuple(r) for r in index.read().collect()), key=str) == sorted([("a", 2, 3), ("b", 1, 1), ("c", 0, 2), (None, 5, 1)], key=str)
    assert index._numbers("base") == [1, 3]


def transitions(spark, events, **days):
    frame = spark.createDataFrame(events, "job string, at timestamp, status string")
    return sorted((r.job, r.at, r.status) for r in jobs.run_jobs(spark, frame, arrivals=3, **days).collect())


def test_jobs_with_timers(spark):
    day = 24 * 60
    events = [
        ("a", at(0), "new"), ("a", at(5), "placed"),  # recycled after 14 days
        ("b", at(0), "new"), ("b", at(7), "failed"), ("b", at(10 * day), "placed"),  # its timer is moved, not due yet
        ("c", at(1), "unplaced"),  # stale 20 days after it was opened
        ("d", at(2), "placed"), ("d", at(13 * day), "cleaned"),  # ended before it is due
        ("e", at(3), "placed"), ("e", at(16 * day), "new"),  # opened again after it was recycled
        ("z", at(21 * day), "new"), (None, at(4), "placed"), ("y", None, "placed"),
    ]
    assert transitions(spark, events, keep_days=14, stale_days=20) == sorted([
        ("a", at(0), "new"), ("a", at(5), "placed"), ("a", at(5 + 14 * day), "recycle"),
        ("b", at(0), "new"), ("b", at(7), "failed"), ("b", at(10 * day), "placed"),
        ("c", at(1), "new"), ("c", at(1), "unplaced"), ("c", at(1 + 20 * day), "stale"),
        ("d", at(2), "new"), ("d", at(2), "placed"), ("d", at(13 * day), "cleaned"),
        ("e", at(3), "new"), ("e", at(3), "placed"), ("e", at(3 + 14 * day), "recycle"), ("e", at(16 * day), "new"), ("z", at(21 * day), "new"),
    ])
    assert transitions(spark, []) == []


def store(spark, path, feeds, length=7):
    name = lambda n: f"c{n}" if n else None
    rows = [(f, name(n), name(n + 1) if n < length - 1 else None, f"{f}{n}") for f in feeds for n in range(length)]
    feed_source.save_pages(spark.createDataFrame(rows, "feed string, cursor string, next string, payload string"), path)


def read(frame):
    return sorted((r.feed, r.number, r.payload) for r in frame.collect())


def test_feed_in_batches_replayed_from_its_offsets(spark, tmp_path):
    path, place = str(tmp_path / "store"), str(tmp_path / "at")
    store(spark, path, ["x", "y z/1"])
    want = [(f, n, f"{f}{n}") for f in ("x", "y z/1") for n in range(7)]
    assert read(feed_source.read_feed(spark, path, at=place, pages_per_batch=3)) == sorted(want)
    offsets = sorted((tmp_path / "at/log/offsets").glob("[0-9]*"))
    assert len(offsets) >= 3
    # a new feed and a restart: only what is new is read
    store(spark, path, ["later"], 2)
    assert read(feed_source.read_feed(spark, path, at=place, pages_per_batch=3)) == sorted([*want, ("later", 0, "later0"), ("later", 1, "later1")])


def test_feed_ends_at_circles_gaps_and_the_cap(spark, tmp_path):
    rows = [("circle", None, "b", "0"), ("circle", "b", "c", "1"), ("circle", "c", "b", "2"), ("gap", None, "missing", "0")] + [("long", f"c{n}" if n else None, f"c{n + 1}", str(n)) for n in range(60)]
    path = str(tmp_path / "store")
    feed_source.save_pages(spark.createDataFrame(rows, "feed string, cursor string, next string, payload string"), path)
    got = read(feed_source.read_feed(spark, path, at=str(tmp_path / "at"), pages_per_batch=25))
    assert [n for f, n, _ in got if f == "circle"] == [0, 1, 2] and [n for f, n, _ in got if f == "gap"] == [0]
    assert [n for f, n, _ in got if f == "long"] == list(range(feed_source.PAGES))


def test_reads_are_tried_again():
    tries = []

    def failing(times):
        def call():
            tries.append(time.monotonic())
            if len(tries) <= times:
                raise OSError("store is away")
            return "page"

        return call

    assert feed_source.retried(failing(2), first_wait=0.05) == "page" and len(tries) == 3
    assert tries[2] - tries[1] > tries[1] - tries[0] > 0.04
    tries.clear()
    with pytest.raises(OSError):
        feed_source.retried(failing(3), first_wait=0.01)
    assert len(tries) == feed_source.ATTEMPTS


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from foliant.operators import tables

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(spark.sparkContext.getConf)

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    monkeypatch.setattr(Context, "getConf", staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key, default=None: default)})))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_slices_hold_every_timed_row(spark):
    frame = spark.range(1000).select(F.timestamp_seconds(F.col("id") * F.col("id")).alias("at"), "id").unionByName(spark.createDataFrame([(None, 1)], "at timestamp, id bigint"))
    parts = runs.slices(frame, "at", 7)
    assert sum(p.count() for p in parts) == 1000 and runs.slices(frame.limit(0), "at", 3) == []


def test_jobs_share_the_state_of_their_bucket(spark, tmp_path):
    """5,000 open jobs are at most a value and a timer for each bucket, and every one of them falls due."""
    events = spark.range(5000).select(F.concat(F.lit("j"), "id").alias("job"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7).alias("at"), F.when(F.col("id") % 2 == 0, "placed").otherwise("failed").alias("status"))
    base, made = str(tmp_path / "s"), []
    commit = lambda batch, number: made.extend(batch.collect())
    before = spark.conf.get(jobs._PROVIDER)
    spark.conf.set(jobs._PROVIDER, jobs._ROCKS)
    try:
        runs.arrive(events, base)
        progress = runs.advance_each(spark, base, lambda rows: jobs.job_stream(rows, keep_days=10, stale_days=20), commit, "append")
        assert 0 < max(p["held"] for p in progress) <= 4 * jobs.BUCKETS
        runs.arrive(runs.marker(events, "at", START + timedelta(days=30)), base)
        runs.advance_each(spark, base, lambda rows: jobs.job_stream(rows, keep_days=10, stale_days=20), commit, "append")
    finally:
        spark.conf.set(jobs._PROVIDER, before)
    assert sorted((r.job, r.status) for r in made) == sorted((f"j{k}", s) for k in range(5000) for s in ("new", *(("placed", "recycle") if k % 2 == 0 else ("failed", "stale"))))


def test_many_feeds_cost_a_reading_of_each_bucket(spark, tmp_path, monkeypatch):
    """800 feeds: the folders and tasks are those of the buckets, whatever the number of feeds."""
    path = str(tmp_path / "store")
    store(spark, path, [f"f{k}" for k in range(800)], 3)
    folders = [p for p in (tmp_path / "store").iterdir() if p.is_dir()]
    assert len(folders) <= feed_source.BUCKETS
    reader = feed_source.FeedReader(feed_source.PageStore(path), 2, 40, 0.01, "")
    end = reader.latestOffset()
    assert len(end) == 800 and len(reader.partitions({}, end)) <= feed_source.BUCKETS
    assert len(read(feed_source.read_feed(spark, path, at=str(tmp_path / "at"), pages_per_batch=2))) == 2400
