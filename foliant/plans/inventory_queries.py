"""Queries over the inventory: duplicates, reports, comparison, destinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import dedupe, layout, library, report
from . import views
from .registry import query

V = views.FILES_SQL
GROUPS_SQL = """dup AS (
  SELECT sha256, arg_min(id, (-priority, -len(string_split(path, '/')), length(path), id)) AS canonical_id, count(*) - 1 AS extra_count,
    CAST(sum(size) - arg_min(size, (-priority, -len(string_split(path, '/')), length(path), id)) AS BIGINT) AS wasted_bytes
  FROM v_files GROUP BY sha256 HAVING count(*) > 1)"""


@query(f"WITH {V}, {GROUPS_SQL} SELECT * FROM dup")
def dup_groups(spark, sf_dir):
    found = dedupe.cascade(views.files(spark, sf_dir, content=True), prefix_bytes=64).select("id", "sha256")
    return dedupe.groups(views.files(spark, sf_dir).drop("sha256").join(found, "id"))


@query(
    f"""WITH {V}, a AS (SELECT size FROM v_files WHERE size > 0 GROUP BY size HAVING count(*) > 1), b AS (SELECT f.size, prefix64 FROM v_files f JOIN a USING (size) GROUP BY ALL HAVING count(*) > 1)
    SELECT f.id, f.size, f.prefix64 AS prefix, f.sha256 FROM v_files f JOIN b ON f.size = b.size AND f.prefix64 = b.prefix64
    UNION ALL SELECT id, size, sha256, sha256 FROM v_files WHERE size = 0"""
)
def hash_cascade(spark, sf_dir):
    return dedupe.cascade(views.files(spark, sf_dir, content=True), prefix_bytes=64)


@query(
    f"""WITH {V}, a AS (SELECT size FROM v_files WHERE size > 0 GROUP BY size HAVING count(*) > 1), b AS (SELECT f.size, prefix64 FROM v_files f JOIN a USING (size) GROUP BY ALL HAVING count(*) > 1)
    SELECT f.id, f.size, f.prefix64 AS prefix, f.sha256 FROM v_files f JOIN b ON f.size = b.size AND f.prefix64 = b.prefix64
    UNION ALL SELECT id, size, sha256, sha256 FROM v_files WHERE size = 0"""
)
def hash_cascade_incremental(spark, sf_dir):
    every = views.files(spark, sf_dir, content=True)
    return dedupe.cascade(every, prefix_bytes=64, known=views.files(spark, sf_dir).filter("id % 3 = 0").select("id", "sha256"))


def _crowded(spark, sf_dir):
    """The inventory with few names, sizes and times, so that many rows collide."""
    files = views.files(spark, sf_dir)
    return files.withColumns({"stem": F.concat(F.lit("F"), F.col("id") % 40), "size": F.floor(F.col("size") / 1000) * 1000, "mtime": F.floor(F.col("mtime") / 5_000_000)})


CROWDED_SQL = f"WITH {V}, n AS (SELECT lower('F' || CAST(id % 40 AS VARCHAR) || ext) AS name, CAST(size // 1000 * 1000 AS BIGINT) AS size, CAST(trunc(mtime) AS BIGINT) // 5000000 AS second, sha256 FROM v_files)"


@query(CROWDED_SQL + " SELECT name, size, second, count(*) AS n, CAST((count(*) - 1) * size AS BIGINT) AS spare_bytes FROM n GROUP BY name, size, second HAVING count(*) > 1")
def quick_collisions(spark, sf_dir):
    return dedupe.quick_collisions(_crowded(spark, sf_dir))


@query(
    f"""WITH {V}, {GROUPS_SQL} SELECT (SELECT count(*) FROM v_files) AS files, (SELECT CAST(sum(size) AS BIGINT) FROM v_files) AS bytes, (SELECT count(*) FROM v_files WHERE group_name IS NULL) AS ungrouped,
    (SELECT count(*) FROM dup) AS dup_groups, (SELECT CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) FROM dup) AS wasted_bytes, (SELECT count(*) FROM orders) AS zips, (SELECT count(*) FROM lineitem) AS zip_entries"""
)
def scan_stats(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return report.scan_stats(files, dedupe.groups(files), views.table(spark, sf_dir, "orders"), views.entries(spark, sf_dir))


@query(f"WITH {V} SELECT source_name, layout, priority, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM v_files GROUP BY ALL")
def source_totals(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return report.source_totals(files.select("source_name", "layout", "priority").distinct(), files)


@query(f"WITH {V}, {GROUPS_SQL} SELECT f.id, f.path, f.sha256, canonical_id, extra_count, wasted_bytes, f.id = canonical_id AS kept FROM v_files f JOIN dup USING (sha256)")
def dup_members(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return report.duplicate_members(files, dedupe.groups(files))


@query(f"WITH {V}, {GROUPS_SQL} SELECT canonical_id, dup.sha256, extra_count, wasted_bytes, f.path AS canonical_path FROM dup JOIN v_files f ON f.id = canonical_id ORDER BY wasted_bytes DESC, dup.sha256 LIMIT 50")
def top_wasted(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return report.top_wasted(dedupe.groups(files), files)


@query(
    f"""WITH {V}, e AS (SELECT l_orderkey AS archive_id, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS inner_path, CAST(trunc(l_quantity) AS BIGINT) * 10 AS size FROM lineitem),
    m AS (SELECT size, count(*) AS members, min((archive_id, inner_path)) AS m FROM e GROUP BY size)
    SELECT f.id, path, f.size, members, m[1] AS archive_id, m[2] AS inner_path FROM v_files f JOIN m USING (size) JOIN orders ON o_orderkey = m[1] ORDER BY f.id LIMIT 100"""
)
def size_hints(spark, sf_dir):
    entries = views.entries(spark, sf_dir).withColumn("size", F.col("size") * 10)
    return report.size_hints(views.files(spark, sf_dir), entries, views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("archive_id")))


@query(f"WITH {V} SELECT ext, count(*) AS n FROM v_files GROUP BY ext")
def ext_histogram(spark, sf_dir):
    return report.extension_histogram(views.files(spark, sf_dir))


@query("SELECT count(l.doc_id) AS attached, count(*) - count(l.doc_id) AS orphan FROM documents d LEFT JOIN labels l USING (doc_id)")
def sidecar_counts(spark, sf_dir):
    return report.attachment_counts(views.sidecars(spark, sf_dir))


@query(
    f"""WITH {V} SELECT relpath, max(size) FILTER (source_name = 'src0') AS src0, max(size) FILTER (source_name = 'src1') AS src1, max(size) FILTER (source_name = 'src2') AS src2, count(*) AS copies, min(sha256) <> max(sha256) AS differs
    FROM v_files WHERE source_name IN ('src0', 'src1', 'src2') GROUP BY relpath ORDER BY relpath LIMIT 2000"""
)
def compare_grid(spark, sf_dir):
    return report.compare_grid(views.files(spark, sf_dir), ["src0", "src1", "src2"])


@query(CROWDED_SQL + " SELECT name, size, second, count(*) AS n, count(DISTINCT sha256) AS digests, count(DISTINCT sha256) > 1 AS mismatch FROM n GROUP BY ALL HAVING count(*) > 1")
def meta_mismatch(spark, sf_dir):
    return report.meta_mismatch(_crowded(spark, sf_dir))


@query(
    f"""WITH {V}, {GROUPS_SQL}, q AS (SELECT lower(stem || ext) AS name, size FROM v_files GROUP BY ALL HAVING count(*) > 1)
    SELECT f.source_name, count(*) FILTER (f.sha256 IN (SELECT sha256 FROM dup)) AS exact_files, coalesce(bool_or((lower(f.stem || f.ext), f.size) IN (SELECT (name, size) FROM q)), false) AS has_quick FROM v_files f GROUP BY f.source_name"""
)
def source_flags(spark, sf_dir):
    files = views.files(spark, sf_dir).withColumn("mtime", F.lit(0.0))
    return report.source_flags(files, dedupe.groups(files), dedupe.quick_collisions(files))


@query(f"WITH {V} SELECT id, bundle, pack, from_pack AS rest FROM v_files")
def bundle_pack(spark, sf_dir):
    return views.files(spark, sf_dir).select("id", paths.bundle_and_pack(F.col("relpath")).alias("s")).select("id", "s.*")


DEST_SQL = """CASE layout WHEN 'keep_relpath' THEN '/library/' || source_name || '/' || relpath WHEN 'by_year' THEN '/library/screenshots/' || year || '/' || stem || ext
  WHEN 'by_year_month' THEN '/library/photos/' || year || '/' || month || '/' || stem || ext WHEN 'pack_tree' THEN '/library/packs/' || bundle || '/' || pack || '/' || from_pack END"""


@query(f"WITH {V} SELECT id, layout, {DEST_SQL} AS dest FROM v_files")
def layout_paths(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return files.select("id", "layout", layout.destination(F.col("layout"), layout.tokens("/library", "/quarantine")).alias("dest"))


MARK_SQL = "left({d}, length({d}) - length(ext)) || '__' || CAST(id AS VARCHAR) || ext"
PLAN_SQL = f"""WITH {V}, {GROUPS_SQL},
  side AS (SELECT *, ext IN ('.txt','.pdf','.docx') AS is_side, regexp_replace(relpath, '/?[^/]*$', '') AS fld FROM v_files),
  par AS (SELECT s.id, min(p.id) AS parent_id FROM side s LEFT JOIN side p ON s.source_name = p.source_name AND s.fld = p.fld AND s.stem = p.stem AND NOT p.is_side WHERE s.is_side GROUP BY s.id),
  m AS (SELECT f.*, coalesce(canonical_id <> f.id, false) AS extra, canonical_id FROM side f LEFT JOIN dup USING (sha256)),
  main0 AS (SELECT *, CASE WHEN extra THEN '/quarantine/' || source_name || '/' || relpath WHEN ext = '.zip' THEN '/library/_zips/' || bundle || '/' || stem || ext ELSE {DEST_SQL} END AS dest0,
    CASE WHEN extra THEN 'quarantine' ELSE 'copy' END AS op, CASE WHEN extra THEN 'exact duplicate; canonical file_id=' || CAST(canonical_id AS VARCHAR) WHEN ext = '.zip' THEN 'archive stored via zip_store' ELSE 'layout ' || layout END AS reason0 FROM m WHERE NOT is_side),
  main AS (SELECT *, row_number() OVER (PARTITION BY dest0 ORDER BY priority DESC, id) > 1 AS late FROM main0),
  mainf AS (SELECT id, path, CASE WHEN late THEN {MARK_SQL.format(d="dest0")} ELSE dest0 END AS dest, op, reason0 || CASE WHEN late THEN '; dest collision renamed' ELSE '' END AS reason FROM main),
  side0 AS (SELECT m.*, regexp_replace(h.dest, '/?[^/]*$', '') AS pdir FROM m LEFT JOIN par USING (id) LEFT JOIN mainf h ON h.id = par.parent_id WHERE is_side),
  side1 AS (SELECT *, CASE WHEN extra THEN '/quarantine/' || source_name || '/' || CASE WHEN pdir IS NULL THEN '_unsorted/' ELSE '' END || relpath WHEN pdir IS NULL THEN '/library/' || source_name || '/_unsorted/' || relpath ELSE pdir || '/_notes/' || stem || ext END AS dest0,
    CASE WHEN extra THEN 'quarantine' ELSE 'copy' END AS op, CASE WHEN extra THEN 'exact duplicate sidecar' WHEN pdir IS NULL THEN 'orphan sidecar' ELSE 'sidecar with parent' END AS reason0 FROM side0),
  side2 AS (SELECT *, row_number() OVER (PARTITION BY dest0 ORDER BY priority DESC, id) > 1 OR dest0 IN (SELECT dest FROM mainf) AS late FROM side1),
  plan AS (SELECT id AS file_id, path AS src, dest, op, reason FROM mainf UNION ALL
    SELECT id, path, CASE WHEN late THEN {MARK_SQL.format(d="dest0")} ELSE dest0 END, op, reason0 || CASE WHEN late THEN '; dest collision renamed' ELSE '' END FROM side2)"""


def _plan(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return layout.plan(files, dedupe.groups(files), layout.attach_sidecars(files))


@query(PLAN_SQL + " SELECT * FROM plan")
def plan_rows(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(PLAN_SQL + " SELECT op, regexp_replace(reason, '=.*|layout .*', '') AS kind, count(*) AS n FROM plan GROUP BY ALL")
def plan_counts(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("op", F.regexp_replace("reason", "=.*|layout .*", "").alias("kind")).agg(F.count("*").alias("n"))


@query(PLAN_SQL + " SELECT * FROM plan ORDER BY file_id LIMIT 500")
def plan_listing(spark, sf_dir):
    return _plan(spark, sf_dir).orderBy("file_id").limit(500)


@query(PLAN_SQL + ", b AS (SELECT doc_id AS id, strlen(text) AS held FROM documents WHERE doc_id % 2 = 0) SELECT p.file_id, p.dest, CASE WHEN held IS NULL THEN p.op WHEN held = f.size THEN 'skipped' ELSE 'error' END AS outcome FROM plan p JOIN v_files f ON f.id = p.file_id LEFT JOIN b ON b.id = p.file_id - p.file_id % 3")
def apply_outcomes(spark, sf_dir):
    """What executing the plan would do where something lies at the destination: same size is done, another size an error."""
    files = views.files(spark, sf_dir)
    there = files.filter("id % 2 = 0").select(F.col("id").alias("at"), F.col("size").alias("held"))
    planned = _plan(spark, sf_dir).join(files.select(F.col("id").alias("file_id"), "size"), "file_id").withColumn("at", F.col("file_id") - F.col("file_id") % 3)
    return planned.join(there, "at", "left").select("file_id", "dest", F.when(F.col("held").isNull(), F.col("op")).when(F.col("held") == F.col("size"), "skipped").otherwise("error").alias("outcome"))


@query(PLAN_SQL + " SELECT file_id, src, dest, op, CASE WHEN starts_with(dest, '/library/') THEN 'would ' || op ELSE 'error' END AS result, CASE WHEN starts_with(dest, '/library/') THEN '' ELSE 'outside the library' END AS note FROM plan")
def apply_dry_run(spark, sf_dir):
    """What the executing operator says of the plan without touching a file; quarantine is no root here."""
    return library.apply_plan(_plan(spark, sf_dir), ["/library"])


@query(f"WITH {V}, s AS (SELECT *, ext IN ('.txt','.pdf','.docx') AS is_side, regexp_replace(relpath, '/?[^/]*$', '') AS fld FROM v_files) SELECT s.id, min(p.id) AS parent_id FROM s LEFT JOIN s p ON s.source_name = p.source_name AND s.fld = p.fld AND s.stem = p.stem AND NOT p.is_side WHERE s.is_side GROUP BY s.id")
def sidecar_parents(spark, sf_dir):
    return layout.attach_sidecars(views.files(spark, sf_dir))


@query(
    f"""WITH {V}, z AS (SELECT id, left(path, length(path) - length(ext)) AS bare FROM v_files WHERE ext = '.zip'), d AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS fld FROM v_files)
    SELECT id, exists(SELECT 1 FROM d WHERE fld = bare OR starts_with(fld, bare || '/')) AS paired FROM z"""
)
def archive_pairs(spark, sf_dir):
    return layout.pair_archives(views.files(spark, sf_dir))


@query(f"WITH {V} SELECT id, lower(path) = '/data/src1' OR starts_with(lower(path), '/data/src1/') AS under FROM v_files")
def path_containment(spark, sf_dir):
    return views.files(spark, sf_dir).select("id", paths.is_under(F.col("path"), F.lit("/data/SRC1/")).alias("under"))


@query(f"WITH {V} SELECT name, is_dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT split_part(relpath, '/', 1) AS name, len(string_split(relpath, '/')) > 1 AS is_dir, size FROM v_files WHERE source_name = 'src3') GROUP BY name, is_dir ORDER BY is_dir DESC, lower(name) LIMIT 800")
def browse(spark, sf_dir):
    """The children of a source's root: folders first, then names."""
    files = views.files(spark, sf_dir).filter("source_name = 'src3'")
    parts = F.split("relpath", "/")
    return files.groupBy(parts[0].alias("name"), (F.size(parts) > 1).alias("is_dir")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("is_dir"), F.lower("name")).limit(800)


@query("SELECT l_orderkey AS archive_id, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS inner_path, CAST(trunc(l_quantity) AS BIGINT) AS size, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY inner_path LIMIT 400")
def zip_contents(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("archive_id"), "o_orderstatus")
    return views.entries(spark, sf_dir).join(orders, "archive_id").orderBy("inner_path", "archive_id", F.desc("size"), "o_orderstatus").limit(400)


@query(
    f"""WITH {V}, p AS (SELECT id, lang, {DEST_SQL} AS dest, size FROM v_files JOIN documents ON doc_id = id), lib AS (SELECT dest, max(size) AS held FROM p WHERE id % 3 <> 1 GROUP BY dest)
    SELECT id, coalesce(held = size, false) AS in_library FROM p LEFT JOIN lib USING (dest)"""
)
def in_library(spark, sf_dir):
    """Whether a file of the same size lies at the rendered destination."""
    files = views.files(spark, sf_dir)
    placed = files.select("id", "size", layout.destination(F.col("layout"), layout.tokens("/library", "/quarantine")).alias("dest"))
    held = placed.filter("id % 3 <> 1").groupBy("dest").agg(F.max("size").alias("held"))
    return placed.join(held, "dest", "left").select("id", F.coalesce(F.col("held") == F.col("size"), F.lit(False)).alias("in_library"))


@query(
    """WITH s AS (SELECT s_suppkey AS id, n_name AS pack, r_name AS bundle, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT bundle, pack, count(*) AS n, min(id) AS first_id FROM s GROUP BY ALL"""
)
def owner_tree(spark, sf_dir):
    t = lambda name: views.table(spark, sf_dir, name)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("bundle"), F.col("n_name").alias("pack")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_id"))
