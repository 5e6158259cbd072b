"""Queries over pages, posts, manifests and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, web
from ..operators import feed, staging
from . import views
from .registry import query

PATTERN = """(?i)href\\s*=\\s*["'']([^"''>\\s]+)["'']"""
HREF_SQL = f"h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{PATTERN}', 1)) AS href FROM pages)"
HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '')"


def _pages(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").withColumn("hrefs", web.hrefs(F.col("html"), web.ANY_HREF))


@query(f"WITH {HREF_SQL} SELECT page_id, href FROM h")
def hrefs(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode("hrefs").alias("href"))


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(web.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT host, n FROM (SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, host LIMIT 10")
def top_hosts(spark, sf_dir):
    return host_counts(spark, sf_dir).orderBy(F.desc("n"), "host").limit(10)


@query(f"WITH {HREF_SQL}, u AS (SELECT page_id AS post_id, 'https://' || CASE WHEN length(href) % 3 = 0 THEN 'www.own.example' ELSE 'h' || CAST(length(href) % 7 AS VARCHAR) || '.example' END || href AS url FROM h WHERE starts_with(href, '/')) SELECT DISTINCT post_id, {HOST} AS host, url FROM u WHERE {HOST} <> 'own.example'")
def outside_links(spark, sf_dir):
    at = F.when(F.length("href") % 3 == 0, "www.own.example").otherwise(F.concat(F.lit("h"), F.length("href") % 7, F.lit(".example")))
    own = hrefs(spark, sf_dir).filter("href LIKE '/%'").select(F.col("page_id").alias("post_id"), F.concat(F.lit("https://"), at, F.col("href")).alias("u"))
    posts = own.groupBy("post_id").agg(F.collect_list("u").alias("hrefs"))
    return feed.outside_links(posts, ["own.example"]).drop("n")


POSTS_SQL = """p AS (SELECT o_orderkey AS post_id, o_custkey % 40 AS creator, o_orderpriority AS title, o_orderstatus <> 'P' AS can_view, o_orderkey % 3 AS media, o_custkey % 4 AS links, o_orderdate AS published FROM orders),
  l AS (SELECT *, CASE WHEN title LIKE '%URGENT%' THEN 'excluded (chronos)' WHEN title LIKE '%LOW%' THEN 'excluded' WHEN NOT can_view THEN 'locked' WHEN media = 0 AND links > 0 THEN 'deferred (outside link)' ELSE 'accessible' END AS label FROM p)"""


def _posts(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    p = o.select(F.col("o_orderkey").alias("post_id"), (F.col("o_custkey") % 40).alias("creator"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "P").alias("can_view"), (F.col("o_orderkey") % 3).alias("media"), (F.col("o_custkey") % 4).alias("links"), F.col("o_orderdate").alias("published"))
    return p.withColumn("label", feed.access_label(F.col("title"), F.col("can_view"), F.col("media"), F.col("links"), ["URGENT|chronos", "LOW"]))


@query(f"WITH {POSTS_SQL} SELECT post_id, label FROM l")
def access_labels(spark, sf_dir):
    return _posts(spark, sf_dir).select("post_id", "label")


@query(f"WITH {POSTS_SQL} SELECT count(*) AS listed, count(*) FILTER (label LIKE 'accessible%') AS accessible, count(*) FILTER (label LIKE 'locked%') AS locked, count(*) FILTER (label LIKE 'excluded%') AS excluded, count(*) FILTER (label LIKE 'deferred%') AS deferred FROM l")
def label_counts(spark, sf_dir):
    return feed.label_counts(_posts(spark, sf_dir))


@query(
    f"""WITH {POSTS_SQL}, s AS (SELECT *, max(CASE WHEN published < TIMESTAMP '1995-01-01' THEN 1 ELSE 0 END) OVER (PARTITION BY creator ORDER BY post_id ROWS UNBOUNDED PRECEDING) AS stop FROM p),
    a AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY post_id) AS n FROM s WHERE stop = 0 AND published < TIMESTAMP '1998-01-01') SELECT creator, post_id FROM a WHERE n <= 5"""
)
def feed_takewhile(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return feed.take_while(_posts(spark, sf_dir), "post_id", key="creator", published="published", since=at("1995-01-01"), until=at("1998-01-01"), most=5).select("creator", "post_id")


@query("SELECT event_id AS id, CASE WHEN timezone('America/New_York', timezone('UTC', ts)) >= TIMESTAMP '2024-01-10' AND timezone('America/New_York', timezone('UTC', ts)) < TIMESTAMP '2024-01-20' THEN 'in' ELSE 'out' END AS inside, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM events")
def window_filter(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("id"), dates.in_window(F.col("at"), "America/New_York", "2024-01-10", "2024-01-20").alias("inside"), dates.local_day(F.col("at"), "America/New_York").alias("day"))


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS day FROM orders")
def months_back(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.months_back(F.col("o_orderdate").cast("date"), 1).alias("day"))


STATUS = "CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber = 5 THEN 'failed' ELSE 'planned' END WHEN 'A' THEN 'skipped-duplicate' ELSE CASE WHEN l_linestatus = 'O' THEN 'downloaded' ELSE 'deferred' END END"


@query(f"WITH s AS (SELECT l_orderkey AS post_id, {STATUS} AS status FROM lineitem) SELECT post_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'downloaded') THEN 'downloaded' WHEN bool_or(status = 'planned') THEN 'planned' WHEN bool_and(status = 'skipped-duplicate') THEN 'skipped-duplicate' WHEN bool_or(status = 'deferred') THEN 'deferred' ELSE 'skipped' END AS status FROM s GROUP BY post_id")
def post_status(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")
    s = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 5, "failed").otherwise("planned")).when(F.col("l_returnflag") == "A", "skipped-duplicate").otherwise(F.when(F.col("l_linestatus") == "O", "downloaded").otherwise("deferred"))
    return feed.post_status(l.select(F.col("l_orderkey").alias("post_id"), s.alias("status")))


@query(
    """WITH f AS (SELECT doc_id AS "order", doc_id // 2 AS media_id, sha256(text) AS sha256 FROM documents), m AS (SELECT DISTINCT media_id FROM f WHERE media_id % 10 = 0), s AS (SELECT DISTINCT sha256 FROM f WHERE "order" % 7 = 0 AND "order" < 500)
    SELECT "order", CASE WHEN media_id IN (SELECT media_id FROM m) OR sha256 IN (SELECT sha256 FROM s) OR row_number() OVER (PARTITION BY sha256 ORDER BY "order") > 1 THEN 'skipped-duplicate' ELSE 'downloaded' END AS outcome FROM f"""
)
def media_dedupe(spark, sf_dir):
    f = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("order"), F.floor(F.col("doc_id") / 2).alias("media_id"), F.sha2("text", 256).alias("sha256"))
    return feed.against_index(f, f.filter("media_id % 10 = 0"), f.filter("`order` % 7 = 0 AND `order` < 500")).select("order", "outcome")


@query(f"WITH {POSTS_SQL}, g AS (SELECT creator AS key, can_view, CASE media WHEN 0 THEN NULL WHEN 1 THEN post_id % 50 = 1 ELSE false END AS gated FROM p) SELECT key, CASE WHEN bool_or(can_view AND coalesce(gated, false)) THEN true WHEN bool_or(can_view AND gated IS NULL) THEN NULL ELSE false END AS member FROM g GROUP BY key")
def membership(spark, sf_dir):
    gated = F.when(F.col("media") == 1, F.col("post_id") % 50 == 1).when(F.col("media") == 2, False)
    return feed.membership(_posts(spark, sf_dir).select(F.col("creator").alias("key"), "can_view", gated.alias("gated")))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_path(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


M_SQL = """e AS (SELECT doc_id AS k, lang || '/' || CAST(doc_id AS VARCHAR) AS rel, strlen(text) AS size, sha256(text) AS sha FROM documents WHERE doc_id % 5 <> 0),
  f AS (SELECT lang || '/' || CAST(doc_id AS VARCHAR) AS rel, strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 13 = 0 THEN sha256('x') ELSE upper(sha256(text)) END AS sha FROM documents WHERE doc_id % 7 <> 0)"""


def _manifests(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("rel"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    found = d.filter("doc_id % 7 <> 0").withColumn("size", F.col("size") + (F.col("doc_id") % 11 == 0).cast("int")).withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper("sha256")))
    return d.filter("doc_id % 5 <> 0"), found


@query(f"WITH {M_SQL} SELECT coalesce(e.rel, f.rel) AS rel, CASE WHEN f.rel IS NULL THEN 'missing' WHEN e.rel IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem FROM e FULL JOIN f ON e.rel = f.rel WHERE f.rel IS NULL OR e.rel IS NULL OR e.size <> f.size OR e.sha <> lower(f.sha)")
def manifest_diff(spark, sf_dir):
    return staging.manifest_diff(*_manifests(spark, sf_dir))


@query(f"WITH {M_SQL} SELECT e.rel, CASE WHEN f.rel IS NULL THEN 'copy' WHEN e.sha = lower(f.sha) THEN 'dup' ELSE 'suffix' END AS action FROM e LEFT JOIN f ON e.rel = f.rel")
def place_actions(spark, sf_dir):
    e, f = _manifests(spark, sf_dir)
    joined = e.join(f.select("rel", F.lower("sha256").alias("held")), "rel", "left")
    return joined.select("rel", staging.place_action(F.col("held").isNotNull(), F.col("held") == F.col("sha256"), False, "suffix").alias("action"))


@query(f"WITH {M_SQL} SELECT e.rel, CASE WHEN k % 17 = 0 THEN 'unsafe' WHEN f.rel IS NULL THEN 'new' WHEN k % 19 = 0 THEN 'unsafe' WHEN e.sha = lower(f.sha) AND e.size = f.size THEN 'unchanged' ELSE 'conflict-backup' END AS action FROM e LEFT JOIN f ON e.rel = f.rel")
def unpack_actions(spark, sf_dir):
    e, f = _manifests(spark, sf_dir)
    joined = e.join(f.select("rel", F.lower("sha256").alias("held"), F.col("size").alias("held_size")), "rel", "left")
    reason = F.when(F.col("doc_id") % 17 == 0, "traversal")
    kind = F.when(F.col("held").isNotNull(), F.when(F.col("doc_id") % 19 == 0, "dir").otherwise("file"))
    return joined.select("rel", staging.unpack_action(reason, kind, (F.col("held") == F.col("sha256")) & (F.col("held_size") == F.col("size")), "backup").alias("action"))


@query("WITH j AS (SELECT event_id AS id, ['placed','failed','unplaced','new'][CAST(event_id % 4 + 1 AS INT)] AS s, ts, event_id % 9 = 0 AS cleaned FROM events) SELECT id, CASE WHEN s = 'placed' AND NOT cleaned AND TIMESTAMP '2024-02-01' >= ts + INTERVAL 14 DAY THEN 'recycle' WHEN s IN ('failed','unplaced') AND TIMESTAMP '2024-02-01' >= ts + INTERVAL 30 DAY THEN 'stale' ELSE 'keep' END AS action FROM j")
def retention(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("placed", "failed", "unplaced", "new"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), staging.retention(status, F.col("ts"), F.col("ts"), F.col("event_id") % 9 == 0, F.lit("2024-02-01").cast("timestamp_ntz")).alias("action"))


@query(
    """WITH r AS (SELECT page_id AS id, [200, 401, 403, 302, 429, 503][page_id % 6 + 1] AS s, page_id % 5 AS k FROM pages)
    SELECT id, CASE WHEN k = 4 THEN 'challenge' WHEN s = 429 THEN 'rate' WHEN s = 302 AND k = 1 THEN 'verification' WHEN k = 2 AND s <> 200 THEN 'verification' WHEN s IN (403, 503) AND k IN (0, 1) THEN 'challenge' WHEN s IN (401, 403) THEN 'auth' WHEN k IN (0, 1) AND s <> 200 THEN 'challenge' END AS kind FROM r"""
)
def http_gate(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 5
    s = F.element_at(F.array(*map(F.lit, (200, 401, 403, 302, 429, 503))), (F.col("page_id") % 6 + 1).cast("int"))
    ctype = F.when(k.isin(0, 1), "text/html; charset=utf-8").otherwise("application/json")
    url = F.when(k == 2, "https://own.example/login").otherwise("https://own.example/api/login")
    return p.select(F.col("page_id").alias("id"), web.response_kind(s, ctype, F.when(k.isin(0, 1), "<p>Just a moment...").otherwise("{}"), url, F.when(k == 1, "https://own.example/login?x=1"), F.when(k == 4, "challenge")).alias("kind"))


@query("""WITH c AS (SELECT c_name AS name, 'v' || CAST(c_custkey AS VARCHAR) AS value, CASE c_nationkey % 3 WHEN 0 THEN '.own.example' WHEN 1 THEN 'www.own.example' ELSE 'notown.example' END AS domain, c_acctbal AS expires FROM customer)
  SELECT string_agg(name || '=' || value, '; ' ORDER BY name, domain) AS header, count(*) AS count, min(expires) FILTER (expires > 0) AS earliest_expiry, CAST(NULL AS VARCHAR) AS error, length(string_agg(name || '=' || value, '; ' ORDER BY name, domain)) AS total_length FROM c WHERE domain <> 'notown.example'""")
def cookie_select(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    k = F.col("c_nationkey") % 3
    cookies = c.select(F.col("c_name").alias("name"), F.concat(F.lit("v"), F.col("c_custkey")).alias("value"), F.when(k == 0, ".own.example").when(k == 1, "www.own.example").otherwise("notown.example").alias("domain"), F.lit("/").alias("path"), F.col("c_acctbal").alias("expires"))
    return staging.cookie_header(cookies, ["own.example"], None, [], 0.0)


@query(
    """WITH o AS (SELECT sha256(text) AS s, min(doc_id) AS first_seen, list_sort(list(source || '/' || CAST(doc_id AS VARCHAR))) AS p FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), f AS (SELECT sha256(text) AS s, min(doc_id) + 100000 AS first_seen, list_sort(list(source || '/' || CAST(doc_id AS VARCHAR))) AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(o.s, f.s) AS sha256, coalesce(o.first_seen, f.first_seen) AS first_seen, list_concat(coalesce(o.p, []), list_filter(coalesce(f.p, []), lambda x: NOT list_contains(coalesce(o.p, []), x))) AS paths_seen, CASE WHEN o.s IS NULL THEN 'new' ELSE 'done' END AS status FROM o FULL JOIN f ON o.s = f.s"""
)
def register_merge(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("p"))
    side = lambda rows, shift: rows.groupBy("sha256").agg((F.min("doc_id") + shift).alias("first_seen"), F.array_sort(F.collect_list("p")).alias("paths_seen"))
    return staging.merge_register(side(d.filter("doc_id % 3 = 0"), 0).withColumn("status", F.lit("done")), side(d.filter("doc_id % 2 = 0"), 100000))


@query("WITH f AS (SELECT lang || '/a b' || CAST(doc_id AS VARCHAR) || '.png' AS rel, strlen(text) AS size, lang, doc_id FROM documents) SELECT rel AS src, 'file' AS role, '/t/' || rel AS dest FROM f WHERE size <= 3000 UNION ALL SELECT rel, 'standin', '/t/' || lang || '/a b' || CAST(doc_id AS VARCHAR) || '.jpg' FROM f WHERE size > 3000 UNION ALL SELECT rel, 'zip', '/t/' || lang || '/a_b' || CAST(doc_id AS VARCHAR) || '.zip' FROM f WHERE size > 3000")
def staging_plan(spark, sf_dir):
    f = views.table(spark, sf_dir, "documents").select(F.concat(F.col("lang"), F.lit("/a b"), F.col("doc_id"), F.lit(".png")).alias("rel"), F.octet_length("text").alias("size"))
    return staging.staging_plan(f, 3000, "/t")


@query("WITH r AS (SELECT event_id AS id, '/d/' || CAST(user_id AS VARCHAR) || '.txt' AS dest, user_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY id) + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS k FROM r), m AS (SELECT *, CASE WHEN user_id % 3 = 0 AND k >= 3 THEN k + 1 ELSE k END AS j FROM n) SELECT id, CASE WHEN j = 1 THEN dest WHEN j > 1000 THEN NULL ELSE '/d/' || CAST(user_id AS VARCHAR) || '_v' || CAST(j AS VARCHAR) || '.txt' END AS final FROM m")
def version_suffixes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("/d/"), F.col("user_id"), F.lit(".txt")).alias("dest"))
    users = e.select("user_id").distinct()
    taken = users.filter("user_id % 2 = 0").select(F.concat(F.lit("/d/"), F.col("user_id"), F.lit(".txt")).alias("dest")).unionByName(users.filter("user_id % 3 = 0").select(F.concat(F.lit("/d/"), F.col("user_id"), F.lit("_v3.txt")).alias("dest")))
    return staging.versions(rows, taken).select("id", "final")
