"""Queries of whole feeds, listings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posts as post_columns
from ..operators import dedupe, feed, geometry, layout, packing, report, tagging
from ..sources import archives
from . import tag_queries, views
from .inventory_queries import CROWDED_SQL, GROUPS_SQL, V, _crowded
from .registry import query

SYNC_SQL = """p AS (SELECT o_orderkey AS post_id, o_custkey % 40 AS creator, o_orderpriority AS title, o_orderstatus <> 'P' AS can_view, 'https://own.example/p/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders),
  m AS (SELECT l_orderkey AS post_id, 'm' || CAST(l_partkey AS VARCHAR) AS media_id, l_linenumber AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'f.zip' WHEN 1 THEN 'f.png' ELSE 'f' END AS name, CASE l_linenumber % 3 WHEN 0 THEN 'zip' WHEN 1 THEN 'loose-media' ELSE 'pdf' END AS kind,
    CAST(trunc(l_quantity) AS BIGINT) * 1000000 AS size, CASE WHEN l_linenumber % 3 = 1 THEN 'image' ELSE 'attachment' END AS source_kind FROM lineitem WHERE l_returnflag <> 'R'),
  k AS (SELECT o_orderkey AS post_id, n, CASE (o_custkey + n) % 3 WHEN 0 THEN 'a.example' WHEN 1 THEN 'b.example' ELSE 'c.example' END AS host FROM orders, (VALUES (0), (1), (2)) t(n) WHERE o_orderstatus = 'F'),
  c AS (SELECT post_id, count(*) FILTER (source_kind <> 'image') AS attachments, count(*) FILTER (source_kind = 'image') AS images FROM m GROUP BY post_id),
  h AS (SELECT post_id, list(host ORDER BY n) AS hosts FROM (SELECT post_id, host, min(n) AS n FROM k GROUP BY ALL) GROUP BY post_id),
  l AS (SELECT p.*, coalesce(attachments, 0) AS attachments, coalesce(images, 0) AS images, coalesce(hosts, []) AS hosts,
    CASE WHEN title LIKE '%LOW%' THEN 'excluded' WHEN NOT can_view THEN 'locked' WHEN coalesce(attachments + images, 0) = 0 AND hosts IS NOT NULL THEN 'deferred (outside link)' ELSE 'accessible' END AS access FROM p LEFT JOIN c USING (post_id) LEFT JOIN h USING (post_id)),
  f0 AS (SELECT creator, m.*, row_number() OVER (PARTITION BY media_id ORDER BY m.post_id, pos) AS nth FROM m JOIN l USING (post_id) WHERE access = 'accessible'),
  f AS (SELECT creator, post_id, media_id, CASE WHEN name = 'f' THEN 'f.pdf' ELSE name END AS name, CASE WHEN kind = 'pdf' THEN 'other' ELSE kind END AS kind, size,
      CASE WHEN nth > 1 OR media_id IN (SELECT 'm' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 40) THEN 'skipped-duplicate' WHEN size > 30 * 1024 * 1024 THEN 'deferred' ELSE 'planned' END AS status FROM f0
    UNION ALL SELECT creator, post_id, NULL, 'x' || CAST(n AS VARCHAR), 'other', NULL, 'deferred' FROM l JOIN k USING (post_id) WHERE access LIKE 'deferred%'),
  s AS (SELECT post_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'planned') THEN 'planned' WHEN bool_and(status = 'skipped-duplicate') THEN 'skipped-duplicate' WHEN bool_or(status = 'deferred') THEN 'deferred' ELSE 'skipped' END AS status FROM f GROUP BY post_id),
  t AS (SELECT l.*, CASE WHEN access = 'accessible' THEN coalesce(s.status, 'skipped') WHEN access LIKE 'excluded%' THEN 'excluded' WHEN access = 'locked' THEN 'locked' ELSE 'deferred' END AS status FROM l LEFT JOIN s USING (post_id))"""


def _tables(spark, sf_dir):
    o, l = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    found = o.select(F.col("o_orderkey").alias("post_id"), (F.col("o_custkey") % 40).alias("creator"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "P").alias("can_view"), F.concat(F.lit("https://own.example/p/"), "o_orderkey").alias("url"))
    k = F.col("l_linenumber") % 3
    media = l.select(
        F.col("l_orderkey").alias("post_id"), F.concat(F.lit("m"), "l_partkey").alias("media_id"), F.col("l_linenumber").alias("pos"), F.when(k == 0, "f.zip").when(k == 1, "f.png").otherwise("f").alias("name"), F.lit("https://cdn.example/1.pdf").alias("url"),
        F.when(k == 0, "zip").when(k == 1, "loose-media").otherwise("pdf").alias("kind"), (F.col("l_quantity").cast("bigint") * 1_000_000).alias("size"), F.when(k == 1, "image").otherwise("attachment").alias("source_kind"),
    )
    n = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("post_id"), "o_custkey", F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
    host = F.element_at(F.array(*map(F.lit, ("a.example", "b.example", "c.example"))), ((F.col("o_custkey") + F.col("n")) % 3 + 1).cast("int"))
    links = n.select("post_id", "n", host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/x"), F.col("n")).alias("url"))
    return found, media, links


def _listed(spark, sf_dir):
    return feed.listed(*_tables(spark, sf_dir), exclude=["LOW"])


def _synced(spark, sf_dir):
    _, media, links = _tables(spark, sf_dir)
    known = views.table(spark, sf_dir, "part").filter("p_size > 40").select(F.concat(F.lit("m"), "p_partkey").alias("media_id"))
    return feed.synced(_listed(spark, sf_dir), media, links, known, max_mb=30)


@query(f"WITH {SYNC_SQL} SELECT creator, post_id, access, attachments, images, hosts FROM l")
def feed_listing(spark, sf_dir):
    return _listed(spark, sf_dir).select("creator", "post_id", "access", "attachments", "images", "hosts")


@query(f"WITH {SYNC_SQL} SELECT post_id, hosts FROM h")
def hosts_first_seen(spark, sf_dir):
    return feed.hosts_in_order(_tables(spark, sf_dir)[2])


@query(f"WITH {SYNC_SQL} SELECT * FROM f")
def feed_sync_files(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


@query(f"WITH {SYNC_SQL} SELECT post_id, access, status FROM t")
def feed_sync_posts(spark, sf_dir):
    return _synced(spark, sf_dir)[0].select("post_id", "access", "status")


@query(f"WITH {SYNC_SQL} SELECT creator, count(*) FILTER (status NOT IN ('failed', 'skipped-duplicate', 'excluded', 'locked', 'deferred')) AS ok, count(*) FILTER (status IN ('skipped-duplicate', 'excluded', 'locked', 'deferred')) AS skipped, count(*) FILTER (status = 'failed') AS failed FROM t GROUP BY creator")
def feed_tally(spark, sf_dir):
    return feed.post_tally(_synced(spark, sf_dir)[0], "creator")


@query(f"WITH {SYNC_SQL} SELECT count(*) FILTER (creator > 3 AND access = 'accessible') AS ok, count(*) FILTER (creator > 3 AND access <> 'accessible') + count(DISTINCT creator) FILTER (creator <= 3) AS skipped, CAST(0 AS BIGINT) AS failed FROM l")
def feed_list_tally(spark, sf_dir):
    found = _listed(spark, sf_dir).withColumnRenamed("access", "label")
    return feed.list_tally(found, "creator", found.filter("creator <= 3").select("creator"))


@query(
    f"""WITH {SYNC_SQL}, r AS (SELECT creator, count(DISTINCT post_id) AS posts, count(*) FILTER (status = 'planned') AS files, count(*) FILTER (status = 'planned' AND kind = 'zip') AS zips, count(*) FILTER (status = 'planned' AND kind = 'loose-media') AS images,
      CAST(round_even(coalesce(sum(size) FILTER (status = 'planned'), 0) / 1048576.0, 0) AS BIGINT) AS mb FROM f GROUP BY creator), o AS (SELECT *, files - zips - images AS others FROM r)
    SELECT *, creator || ': ' || posts || ' posts, ' || files || ' files (' || zips || ' zip' || CASE WHEN images > 0 THEN ', ' || images || ' image' ELSE '' END || CASE WHEN others > 0 THEN ', ' || others || ' other' ELSE '' END || '), ' || mb || ' MB would stage' AS text FROM o"""
)
def feed_ready(spark, sf_dir):
    return feed.ready_summary(_synced(spark, sf_dir)[1], "creator")


@query(
    f"""WITH {SYNC_SQL}, g AS (SELECT post_id, pos AS n, name, 'planned' AS status, size FROM m)
    SELECT p.post_id, coalesce(n, 0) AS n, '"' || p.post_id || '","' || replace(title, '"', '''') || '","' || url || '","open","' || coalesce(name, '') || '","' || coalesce(g.status, '') || '","","","' || coalesce(CAST(size AS VARCHAR), '') || '",""' AS line FROM p LEFT JOIN g ON g.post_id = p.post_id"""
)
def feed_csv(spark, sf_dir):
    found, media, _ = _tables(spark, sf_dir)
    none = F.lit(None).cast("string")
    files = media.select("post_id", F.col("pos").alias("n"), "name", F.lit("planned").alias("status"), none.alias("staging_path"), none.alias("sha256"), "size", none.alias("host"))
    return feed.csv_lines(found.withColumn("status", F.lit("open")), files)


@query(f"WITH {SYNC_SQL} SELECT post_id, media_id, pos FROM m WHERE source_kind = 'image'")
def media_of_type(spark, sf_dir):
    return feed.selected_media(_tables(spark, sf_dir)[1], ["image"]).select("post_id", "media_id", "pos")


LINKS_SQL = """h AS (SELECT page_id AS post_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''>\\s]+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''>\\s]+)["'']', 1), 1) AS pos FROM pages),
  u AS (SELECT post_id, pos, CASE WHEN length(href) % 3 = 0 THEN 'https://files.own.example' ELSE 'https://other.example' END || '/' || replace(href, '/', '_') || CASE length(href) % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' ELSE '_' END AS url FROM h),
  d AS (SELECT post_id, url, min(pos) AS pos FROM u WHERE url LIKE '%own.example/%' AND regexp_matches(url, '\\.(zip|pdf)$') GROUP BY ALL)"""


@query(f"WITH {LINKS_SQL} SELECT post_id, 'content-' || post_id || '-' || row_number() OVER (PARTITION BY post_id ORDER BY pos) AS media_id, regexp_extract(url, '([^/]*)$', 1) AS name, url, CASE WHEN url LIKE '%.zip' THEN 'zip' ELSE 'other' END AS kind FROM d")
def content_links(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    h = p.select(F.col("page_id").alias("post_id"), F.posexplode(F.regexp_extract_all("html", F.lit("""(?i)href\\s*=\\s*["']([^"'>\\s]+)["']"""), F.lit(1))).alias("pos", "href"))
    n = F.length("href")
    end = F.when(n % 4 == 0, ".zip").when(n % 4 == 1, ".png").when(n % 4 == 2, ".pdf").otherwise("_")
    url = F.concat(F.when(n % 3 == 0, "https://files.own.example").otherwise("https://other.example"), F.lit("/"), F.replace(F.col("href"), F.lit("/"), F.lit("_")), end)
    return feed.content_files(h.select("post_id", "pos", url.alias("url")), ["own.example"])


@query("SELECT o_orderkey AS post_id, o_custkey % 40 AS feed, o_orderpriority AS title, o_orderstatus <> 'P' AS can_view, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS gated FROM orders")
def page_posts(spark, sf_dir):
    """Posts written as JSON:API pages, one for each feed and priority, and read again."""
    attributes = F.struct(F.col("title"), F.col("can_view").alias("current_user_can_view"), F.when(F.col("status") == "O", True).alias("is_public"), F.when(F.col("status") == "F", True).alias("is_paid"))
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("post").alias("type"), (F.col("o_custkey") % 40).alias("feed"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "P").alias("can_view"), F.col("o_orderstatus").alias("status"))
    pages = o.groupBy(F.concat_ws("/", F.col("feed").cast("string"), "title").alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "type", attributes.alias("attributes"))).alias("data"))).alias("payload"))
    found = feed.posts_of(pages)
    return found.select(F.col("post_id").cast("bigint").alias("post_id"), F.split("page", "/")[0].cast("bigint").alias("feed"), "title", "can_view", "gated")


@query("SELECT DISTINCT l_orderkey AS post_id, CAST(l_partkey AS VARCHAR) AS media_id, 'f' || CAST(l_partkey AS VARCHAR) AS name, 'https://cdn.example/' || CAST(l_partkey AS VARCHAR) AS url, 'other' AS kind, l_partkey * 10 AS size FROM lineitem")
def page_media(spark, sf_dir):
    """Files of posts, referred to by relationships and found among what the page includes."""
    l = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post"), F.col("l_partkey").alias("part"))
    ref = F.struct(F.col("part").cast("string").alias("id"), F.lit("media").alias("type"))
    item = F.struct(F.col("part").cast("string").alias("id"), F.lit("media").alias("type"), F.struct(F.concat(F.lit("f"), "part").alias("name"), F.concat(F.lit("https://cdn.example/"), "part").alias("url"), (F.col("part") * 10).alias("size")).alias("attributes"))
    posts = l.groupBy("post").agg(F.collect_list(ref).alias("refs"), F.collect_set(item).alias("items"))
    data = F.array(F.struct(F.col("post").cast("string").alias("id"), F.lit("post").alias("type"), F.create_map(F.lit("attachments"), F.struct(F.col("refs").alias("data"))).alias("relationships")))
    pages = posts.select(F.col("post").alias("page"), F.to_json(F.struct(data.alias("data"), F.col("items").alias("included"))).alias("payload"))
    return feed.media_of(pages).withColumn("post_id", F.col("post_id").cast("bigint"))


@query("SELECT page_id, page_id // 10 AS feed, page_id % 10 AS number FROM pages WHERE page_id % 10 < 5")
def paged_feed(spark, sf_dir):
    """Pages in chains of cursors: the reader stops after five."""
    p = views.table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("feed"), (F.col("page_id") % 10).alias("k"))
    name = lambda k: F.when(k > 0, F.concat(F.lit("c"), k))
    return feed.paged(p.select("page_id", "feed", name(F.col("k")).alias("cursor"), name(F.col("k") + 1).alias("next")), 5).select("page_id", "feed", F.col("number").cast("bigint").alias("number"))


VOLUMES = ("a.zip.002", "a.zip.001", "map.z02", "MAP.zip", "map.z01", "one.part1.rar", "b.zip.001.partial", "plain.txt", "x.z01", "dungeon_pt2.png", "dungeon_pt1.png")


@query("SELECT doc_id // 11 AS set_id, base, parts FROM documents, (VALUES ('a.zip', ['a.zip.001', 'a.zip.002'], 1), ('map.zip', ['map.z01', 'map.z02', 'MAP.zip'], 4), ('dungeon.png', ['dungeon_pt1.png', 'dungeon_pt2.png'], 10)) v(base, parts, last) WHERE doc_id % 11 = 0 AND doc_id + last <= (SELECT max(doc_id) FROM documents)")
def split_groups(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 11).alias("set_id"), F.element_at(F.array(*map(F.lit, VOLUMES)), (F.col("doc_id") % 11 + 1).cast("int")).alias("name"))
    return feed.split_sets(d, "set_id")


ACCOUNTS = (
    ('{"data":{"id":"u","relationships":{"memberships":{"data":[{"id":"1","type":"member"}]}}},"included":[{"id":"1","type":"member","attributes":{"patron_status":"active_patron","campaign_id":"9"}}]}', True),
    ('{"data":{"id":"u","relationships":{"memberships":{"data":[{"id":"1","type":"member"}]}}},"included":[{"id":"1","type":"member","attributes":{"patron_status":"former_patron","campaign_id":"9"}}]}', False),
    ('{"data":{"id":"u","relationships":{"pledges":{"data":[{"id":"2","type":"pledge"}]}}},"included":[{"id":"2","type":"pledge","attributes":{"amount_cents":"500"},"relationships":{"campaign":{"data":[{"id":"8","type":"campaign"}]}}}]}', False),
    ('{"data":{"id":"u","relationships":{"memberships":{"data":[]}}},"included":[]}', None),
    ('{"data":{"id":"u"}}', None),
    ('{"data":{"id":"u","relationships":{"memberships":{"data":[{"id":"3","type":"member"}]}}},"included":[{"id":"3","type":"member","attributes":{"currently_entitled_amount_cents":"300"},"relationships":{"campaign":{"data":[{"id":"9","type":"campaign"}]}}}]}', True),
)
CAMPAIGNS = (
    ('{"data":{"id":"9","attributes":{"current_user_is_free_member":true}}}', True),
    ('{"data":{"id":"9","attributes":{"current_user_is_free_member":false},"relationships":{"current_user_pledge":{"data":[{"id":"4","type":"pledge"}]}}}}', True),
    ('{"data":{"id":"9"},"included":[{"id":"5","type":"member","attributes":{"patron_status":"active_patron","campaign_id":"9"}}]}', True),
    ('{"data":{"id":"9"},"included":[{"id":"5","type":"member","attributes":{"patron_status":"active_patron","campaign_id":"8"}}]}', None),
    ('{"data":{"id":"9","relationships":{"current_user_pledge":{"data":null}}}}', None),
)


def _payloads(spark, sf_dir, given):
    n = len(given)
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.element_at(F.array(*[F.lit(p) for p, _ in given]), (F.col("doc_id") % n + 1).cast("int")).alias("payload"), F.lit("9").alias("campaign_id"))


def _expected(given):
    return f"SELECT doc_id AS key, [{', '.join('NULL' if w is None else str(w).lower() for _, w in given)}][doc_id % {len(given)} + 1] AS member FROM documents"


@query(_expected(ACCOUNTS))
def account_membership(spark, sf_dir):
    return feed.account_membership(_payloads(spark, sf_dir, ACCOUNTS))


@query(_expected(CAMPAIGNS))
def campaign_membership(spark, sf_dir):
    return feed.campaign_membership(_payloads(spark, sf_dir, CAMPAIGNS))


@query(
    f"""WITH {V}, z AS (SELECT left(path, length(path) - length(ext)) AS bare FROM v_files WHERE ext = '.zip'), d AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS fld FROM v_files), p AS (SELECT exists(SELECT 1 FROM d WHERE fld = bare OR starts_with(fld, bare || '/')) AS paired FROM z)
    SELECT count(*) FILTER (paired) AS paired, count(*) FILTER (NOT paired) AS unpaired FROM p"""
)
def pairing_counts(spark, sf_dir):
    return report.pairing_counts(layout.pair_archives(views.files(spark, sf_dir)))


@query(f"WITH {V} SELECT source_name, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes FROM v_files GROUP BY ALL")
def pack_payloads(spark, sf_dir):
    return report.payload_totals(views.files(spark, sf_dir), "source_name")


@query("SELECT count(*) FILTER (event_type IN ('click', 'view')) AS ok, count(*) FILTER (event_type = 'login') AS skipped, count(*) FILTER (event_type NOT IN ('click', 'view', 'login')) AS failed FROM events")
def run_tallies(spark, sf_dir):
    return report.run_tally(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("result")), ("click", "view"), ("login",))


@query(f"WITH {V} SELECT path FROM v_files WHERE group_name = 'fr' ORDER BY path LIMIT 200")
def ungrouped_paths(spark, sf_dir):
    return report.ungrouped(views.files(spark, sf_dir).withColumn("group_name", F.when(F.col("group_name") != "fr", F.col("group_name"))))


@query(CROWDED_SQL.replace("sha256 FROM v_files)", "id, sha256 FROM v_files)") + " SELECT id, count(*) OVER (PARTITION BY sha256) > 1 AS in_hash, count(*) OVER (PARTITION BY name, size, second) > 1 AS in_meta FROM n")
def duplicate_flags(spark, sf_dir):
    files = _crowded(spark, sf_dir)
    return report.duplicate_flags(files, dedupe.groups(files), dedupe.quick_collisions(files))


@query(f"WITH {V}, {GROUPS_SQL}, q AS (SELECT CAST((count(*) - 1) * size AS BIGINT) AS spare FROM v_files GROUP BY lower(stem || ext), size HAVING count(*) > 1) SELECT (SELECT count(*) FROM v_files) AS files, (SELECT CAST(sum(size) AS BIGINT) FROM v_files) AS bytes, (SELECT CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) FROM dup) AS deep_spare, (SELECT CAST(coalesce(sum(spare), 0) AS BIGINT) FROM q) AS quick_spare, true AS stale")
def library_overview(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return report.overview(files, dedupe.groups(files), dedupe.quick_collisions(files.withColumn("mtime", F.lit(0.0))), "2024-01-01 00:00:00", "2024-01-01 00:02:10", 120.0)


@query(f"WITH {V}, {GROUPS_SQL}, a AS (SELECT DISTINCT source_name AS s, sha256 IN (SELECT sha256 FROM dup) AS d FROM v_files), b AS (SELECT s, CASE WHEN bool_or(d) THEN 0 ELSE 1 END AS tier FROM a GROUP BY s) SELECT CAST(row_number() OVER (ORDER BY tier, s) - 1 AS INT) AS number, s AS source_name FROM b ORDER BY tier, s LIMIT 5")
def column_pick(spark, sf_dir):
    files = views.files(spark, sf_dir)
    every = files.select("source_name", F.col("source_name").alias("at")).distinct()
    having = files.join(dedupe.groups(files).select("sha256"), "sha256", "left_semi").select("source_name", F.col("source_name").alias("at")).distinct()
    return report.pick_columns(having, every, "source_name", 5)


@query(f"WITH {V} SELECT id, path FROM v_files")
def register_listing(spark, sf_dir):
    return report.register_order(views.files(spark, sf_dir).select("id", "path"))


@query(
    tag_queries.TAG_PLAN_SQL
    + """, y AS (SELECT DISTINCT 'mkdir' AS op, regexp_replace(dst, '/?[^/]*$', '') AS rel, NULL AS src, regexp_replace(dst, '/?[^/]*$', '') AS dst FROM z WHERE proposal = 'move' UNION ALL SELECT proposal, rel, rel, CASE WHEN proposal = 'move' THEN dst END FROM z WHERE proposal IN ('move', 'recycle')), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY op ORDER BY rel) AS VARCHAR) AS n FROM y)
    SELECT op || '-' || lpad(n, CAST(greatest(4, length(n)) AS INT), '0') AS id, op, src, dst FROM w"""
)
def tag_action_rows(spark, sf_dir):
    return tagging.action_rows(tag_queries._plan(spark, sf_dir))


@query("WITH c AS (SELECT l_orderkey AS sheet, l_linenumber AS cell, l_linenumber * 10 % 37 AS x, l_partkey % 23 AS y FROM lineitem), p AS (SELECT l_orderkey AS sheet, l_suppkey % 40 AS x, l_partkey % 25 AS y FROM lineitem) SELECT sheet, cell, x, y FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.sheet = c.sheet AND abs(p.x - c.x) <= 2 AND abs(p.y - c.y) <= 2)")
def missing_cells(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")
    cells = l.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("cell"), (F.col("l_linenumber") * 10 % 37).alias("x"), (F.col("l_partkey") % 23).alias("y"))
    return geometry.missing_cells(cells, l.select(F.col("l_orderkey").alias("sheet"), (F.col("l_suppkey") % 40).alias("x"), (F.col("l_partkey") % 25).alias("y")), "sheet")


@query("WITH e AS (SELECT l_orderkey AS sheet, min(l_partkey % 6) AS t, 100 - max(l_partkey % 6 + 90) AS b, min(l_suppkey % 5) AS l, 80 - max(l_suppkey % 5 + 74) AS r FROM lineitem GROUP BY 1), s AS (SELECT sheet, CASE WHEN t >= 2 THEN t ELSE 0 END AS t, CASE WHEN b >= 2 THEN b ELSE 0 END AS b, CASE WHEN l >= 2 THEN l ELSE 0 END AS l, CASE WHEN r >= 2 THEN r ELSE 0 END AS r FROM e) SELECT sheet, (t + b) * 80 + (l + r) * 100 - (t + b) * (l + r) AS pixels, coalesce(nullif(concat_ws(', ', CASE WHEN t > 0 THEN 'top ' || t || 'px' END, CASE WHEN b > 0 THEN 'bottom ' || b || 'px' END, CASE WHEN l > 0 THEN 'left ' || l || 'px' END, CASE WHEN r > 0 THEN 'right ' || r || 'px' END), ''), 'none') AS notes FROM s")
def sheet_padding(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")
    return geometry.padding(l.select(F.col("l_orderkey").alias("sheet"), (F.col("l_suppkey") % 5).alias("x"), (F.col("l_partkey") % 6).alias("y"), F.lit(74).alias("w"), F.lit(90).alias("h")), "sheet", 80, 100)


@query("SELECT o_orderkey AS post_id, o_orderdate < TIMESTAMP '1996-01-01' AS early, o_totalprice > 2 * 1024 * 1024 AS big FROM orders")
def post_filters(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("post_id"), post_columns.before_day(F.col("o_orderdate").cast("timestamp"), "UTC", F.lit("1996-01-01")).alias("early"), post_columns.too_big(F.col("o_totalprice"), F.lit(2)).alias("big"))


@query("SELECT 's' || source AS source, CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS problem FROM documents")
def pack_round_trip(spark, sf_dir):
    """Documents packed by source in bounded volumes, the archives read again and held against the manifest."""
    d = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), "source").alias("source"), F.concat("doc_id", F.lit(".txt")).alias("rel"), F.octet_length("text").alias("size"), F.col("text").cast("binary").alias("content"))
    whole = packing.packed(packing.volumes(d, "source", 1 << 20))
    members = archives.archive_members(whole.select(F.col("archive").alias("path"), "content"))
    manifest = d.select("rel", "size", F.sha2("content", 256).alias("sha256"))
    problems = packing.against_manifest(members, manifest)
    return members.join(problems, F.col("name") == F.col("rel"), "left").select(F.regexp_replace("path", "-[0-9]+$", "").alias("source"), "name", "size", "sha256", "problem")


@query("WITH e AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '.txt' AS name, strlen(text) AS size FROM documents) SELECT name, CASE WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'unsafe' WHEN doc_id % 10 = 3 THEN 'conflict-backup' ELSE 'unchanged' END AS action FROM e")
def unpack_plan(spark, sf_dir):
    """What unpacking would do where some files are missing, are folders, or differ."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("rel"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))
    members = d.select(F.lit("a.zip").alias("path"), F.col("rel").alias("name"), "size", "sha256", F.lit(None).cast("string").alias("reason"), F.col("doc_id").cast("int").alias("ord"))
    k = F.col("doc_id") % 10
    there = d.filter(k != 1).select("rel", F.when(k == 2, "dir").otherwise("file").alias("kind"), "size", F.when(k == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return packing.member_actions(members, there, "backup").select("name", "action")


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '*.tmp' WHEN 1 THEN 'cache' END AS excluded FROM documents")
def walk_excludes(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "a/b.tmp").when(F.col("doc_id") % 3 == 1, "x/cache/y").otherwise("x/y.txt").alias("relpath"))
    return packing.kept_and_excluded(d, ["*.tmp", "cache"]).select("id", "excluded")


IMAGES = (
    ("89504E470D0A1A0A0000000D49484452000000400000002008000000", 64, 32, "png"), ("4749463839610A001400", 10, 20, "gif"), ("524946461E000000574542505650385816000000" + "00000000" + "3F0000" + "1F0000", 64, 32, "webp"),
    ("49492A000800000002000001030001000000400000000101030001000000200000000000", 64, 32, "tiff"), ("FFD8FFE000040000FFC0000B080020004001011100", 64, 32, "jpeg"), ("00010203", None, None, None),
)


@query("SELECT doc_id AS id, " + ", ".join(f"([{', '.join('NULL' if r[k] is None else repr(r[k]) for r in IMAGES)}])[doc_id % {len(IMAGES)} + 1] AS {n}" for k, n in ((1, "width"), (2, "height"), (3, "kind"))) + " FROM documents")
def image_dimensions(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.unhex(F.element_at(F.array(*[F.lit(r[0]) for r in IMAGES]), (F.col("doc_id") % len(IMAGES) + 1).cast("int"))).alias("content"))
    return archives.dimensions(d).select(F.col("path").cast("bigint").alias("id"), "width", "height", "kind")
