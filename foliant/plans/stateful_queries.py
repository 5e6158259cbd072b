"""Queries over ordered actions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import actions
from ..operators.tables import shared_dir
from ..streaming import bursts as streams
from ..streaming import feed_source, jobs
from . import views
from .registry import query

OP_SQL = "CASE role WHEN 'system' THEN 'mkdir' WHEN 'user' THEN CASE WHEN turn % 3 = 0 THEN 'copy' ELSE 'move' END ELSE 'recycle' END"


def _actions(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    op = F.when(F.col("role") == "system", "mkdir").when(F.col("role") == "user", F.when(F.col("turn") % 3 == 0, "copy").otherwise("move")).otherwise("recycle")
    at = lambda n: F.concat(F.lit("/w/f"), n.cast("string"))
    src = F.when(op != "mkdir", at(F.col("turn") % 4))
    dst = F.when(op == "mkdir", F.lit("/w/new")).when(op.isin("copy", "move"), at(F.length("text") % 5 + 2))
    return c.select(F.col("conv_id").cast("string").alias("plan"), F.col("turn").alias("idx"), op.alias("op"), src.alias("src"), dst.alias("dst"), F.lit(None).cast("string").alias("sha256"))


@query()
def action_fold(spark, sf_dir):
    """Dry run of every plan; tested against a plain simulation."""
    acts = _actions(spark, sf_dir)
    there = acts.select("plan").distinct().select("plan", F.explode(F.array(*[F.lit(f"/w/f{n}") for n in range(3)])).alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("sha256"))
    return actions.replay(acts, there)


@query(
    f"""WITH a AS (SELECT CAST(conv_id AS VARCHAR) AS plan, turn, {OP_SQL} AS o, '/w/f' || CAST(turn % 4 AS VARCHAR) AS s, '/w/f' || CAST(length(text) % 5 + 2 AS VARCHAR) AS d FROM conversations)
    SELECT plan, -turn AS undo_order, CASE o WHEN 'move' THEN 'move' WHEN 'copy' THEN 'recycle' WHEN 'mkdir' THEN 'rmdir' ELSE 'manual' END AS op, CASE o WHEN 'mkdir' THEN '/w/new' WHEN 'recycle' THEN s ELSE d END AS src, CASE o WHEN 'move' THEN s END AS dst FROM a"""
)
def undo_replay(spark, sf_dir):
    return actions.inverse(_actions(spark, sf_dir))


@query("WITH e AS (SELECT user_id, epoch(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600 THEN 0 ELSE 1 END AS cut FROM e), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT CAST(user_id AS VARCHAR) AS parent_rel, CAST(floor(min(t)) AS BIGINT) AS first_second, count(*) AS members FROM r GROUP BY user_id, run HAVING count(*) > 1")
def stream_bursts(spark, sf_dir):
    """Bursts as a stream of session windows, run over what there is."""
    return streams.run_bursts(spark, f"{sf_dir}/events.parquet", "1 hour")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def stream_index(spark, sf_dir):
    """The digest index kept up by a stream of documents."""
    return streams.run_index(spark, f"{sf_dir}/documents.parquet")


STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'placed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'unplaced' ELSE 'new' END"


@query(
    f"""WITH e AS (SELECT user_id || '-' || strftime(ts, '%d') AS job, date_trunc('millisecond', CAST(ts AS TIMESTAMP)) AS ms, CAST(ts AS TIMESTAMP) AS t0, {STATUS_SQL} AS status FROM events),
    f AS (SELECT job, min(t0) AS opened FROM e GROUP BY job),
    l AS (SELECT job, arg_max(status, (t0, status)) AS status, max(ms) AS ms FROM e WHERE status <> 'new' GROUP BY job),
    due AS (SELECT job, CASE status WHEN 'placed' THEN 'recycle' ELSE 'stale' END AS status, CASE status WHEN 'placed' THEN ms + INTERVAL 10 DAY ELSE date_trunc('millisecond', opened) + INTERVAL 20 DAY END AS t0 FROM l JOIN f USING (job)),
    r AS (SELECT job, opened AS t0, 'new' AS status FROM f UNION ALL SELECT job, t0, status FROM e WHERE status <> 'new' UNION ALL SELECT job, t0, status FROM due WHERE t0 <= (SELECT max(t0) FROM e))
    SELECT job, epoch_us(t0) AS at_us, status FROM r"""
)
def stream_jobs(spark, sf_dir):
    """A user's day is a job: its outcomes, and what falls due by the end of the table, from keyed state with timers."""
    e = views.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "placed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "unplaced").otherwise("new")
    events = e.select(F.concat_ws("-", "user_id", F.date_format("ts", "dd")).alias("job"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"))
    return jobs.run_jobs(spark, events, keep_days=10, stale_days=20).select("job", F.unix_micros("at").alias("at_us"), "status")


@query("SELECT page_id, CAST(page_id // 10 AS VARCHAR) AS feed, CAST(page_id % 10 AS INT) AS number, url AS payload FROM pages WHERE page_id % 10 < 5")
def stream_feed(spark, sf_dir):
    """Feeds of ten pages as a source whose offsets are cursors: two pages a batch, five of a feed."""
    name = lambda k: F.when(k > 0, F.concat(F.lit("c"), k))
    p = views.table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).cast("string").alias("feed"), (F.col("page_id") % 10).alias("k"), "url")
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    feed_source.save_pages(p.select("feed", name(F.col("k")).alias("cursor"), name(F.col("k") + 1).alias("next"), "url").withColumnRenamed("url", "payload"), path)
    got = feed_source.read_feed(spark, path, pages_per_batch=2, max_pages=5)
    return got.select((F.col("feed").cast("bigint") * 10 + F.col("number")).alias("page_id"), "feed", "number", "payload")
