"""Queries over tagging, parts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, paths, sniff
from ..operators import dedupe, geometry, parts, tagging
from . import views
from .registry import query

V = views.FILES_SQL
HEADER = """CASE id % 7 WHEN 0 THEN '89504E470D0A1A0A00' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '504B0304' WHEN 3 THEN '4D5A9000' WHEN 4 THEN '526172211A0700' WHEN 5 THEN '255044462D' ELSE '52494646000000005745425000' END"""
EXTS = "['.png','.jpg','.txt','.pdf','.zip','.docx','.exe','.bin','.msi','.esp','.pak','.gguf','.pt','.xyz']"
TAG_SQL = f"""WITH t AS (SELECT doc_id AS id, {EXTS}[doc_id % 14 + 1] AS ext, CASE WHEN doc_id % 11 = 0 THEN 'Dungeon-Map' ELSE 'file' END || CAST(doc_id AS VARCHAR) AS stem, CAST(strlen(text) AS BIGINT) AS size, {HEADER.replace("id", "doc_id")} AS h FROM documents),
  m AS (SELECT *, CASE WHEN starts_with(h, '8950') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '5249') THEN 'webp' END AS pic, CASE WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, '5261') THEN 'rar' END AS pack FROM t),
  r AS (SELECT *, CASE WHEN ext = '.gguf' THEN ['_ModelWeights','high','ext-gguf'] WHEN ext IN ('.pt','.bin') AND size >= 3000 THEN ['_ModelWeights','high','size-large-weight'] WHEN ext IN ('.pt','.bin') THEN ['_Unknown','unsure','ext-small-weight']
    WHEN ext IN ('.exe','.msi') AND starts_with(h, '4D5A') THEN ['_Installers','high','magic-mz'] WHEN ext = '.msi' THEN ['_Installers','high','ext-msi'] WHEN ext = '.exe' THEN ['_Installers','low','ext-exe-no-mz']
    WHEN ext IN ('.txt','.pdf','.docx') THEN ['_Documents','high','ext-' || ext[2:]] WHEN ext = '.esp' THEN ['_GameMods','high','ext-esp'] WHEN ext = '.pak' THEN ['_GameMods','low','ext-pak']
    WHEN lower(stem || ext) LIKE '%dungeon-map%' AND (pic IS NOT NULL OR ext IN ('.png','.jpg')) THEN ['_Maps','low','name-map'] WHEN pack IS NOT NULL THEN ['_Archives','high','magic-' || pack] WHEN ext = '.zip' THEN ['_Archives','high','ext-zip']
    WHEN pic IS NOT NULL THEN ['_Images','low','magic-' || pic] WHEN ext IN ('.png','.jpg') THEN ['_Images','low','ext-' || ext[2:]] ELSE ['_Unknown','unsure','none'] END AS hit FROM m)"""


def _tagged(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    exts = (".png", ".jpg", ".txt", ".pdf", ".zip", ".docx", ".exe", ".bin", ".msi", ".esp", ".pak", ".gguf", ".pt", ".xyz")
    heads = ("89504E470D0A1A0A00", "FFD8FFE0", "504B0304", "4D5A9000", "526172211A0700", "255044462D", "52494646000000005745425000")
    t = d.select(
        F.col("doc_id").alias("id"), F.element_at(F.array(*map(F.lit, exts)), (F.col("doc_id") % 14 + 1).cast("int")).alias("ext"),
        F.concat(F.when(F.col("doc_id") % 11 == 0, "Dungeon-Map").otherwise("file"), F.col("doc_id")).alias("stem"), F.octet_length("text").cast("bigint").alias("size"),
        F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 7 + 1).cast("int"))).alias("header"), F.sha2("text", 256).alias("sha256"),
    )
    return t.withColumn("hit", sniff.classify(F.concat("stem", "ext"), F.col("ext"), F.col("size"), F.col("header"), 3000))


@query(TAG_SQL + " SELECT id, hit[1] AS bin, hit[2] AS confidence, hit[3] AS rule FROM r")
def rule_bins(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", "hit.*")


@query(TAG_SQL + " SELECT hit[1] AS bin, hit[2] AS confidence, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY ALL")
def bin_counts(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("hit.bin", "hit.confidence").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(TAG_SQL + " SELECT id, coalesce(pic IN ('png','jpeg','webp') AND size <= 3000, false) AS ok FROM r")
def sendable_images(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", sniff.sendable_image(F.col("header"), F.col("ext"), F.col("size"), 3000)["ok"].alias("ok"))


@query(
    """WITH n AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part), f AS (SELECT id, list_filter([CASE WHEN n LIKE '%red%' OR n LIKE '%blue%' THEN 'colour' END, CASE WHEN n LIKE '%ring%' OR n LIKE '%large%' THEN 'thing' END], lambda x: x IS NOT NULL) AS f FROM n)
    SELECT id, CASE WHEN len(f) = 1 THEN f[1] ELSE '_Unknown' END AS bin, CASE WHEN len(f) = 1 THEN 'high' ELSE 'unsure' END AS confidence, CASE WHEN len(f) = 1 THEN 'hint-' || f[1] WHEN len(f) > 1 THEN 'hint-ambiguous' ELSE 'no-hint' END AS rule FROM f"""
)
def hint_bins(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), sniff.match_hints(F.col("p_name"), {"colour": ["RED", "blue"], "thing": ["ring", "large"]}).alias("h")).select("id", "h.*")


@query(
    TAG_SQL
    + """, a AS (SELECT id, hit[1] AS b, hit[2] AS c, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN hit[1] WHEN 2 THEN '_Images' ELSE 'Unsure' END AS x, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '_Images' ELSE 'Unsure' END AS y FROM r)
    SELECT id, CASE WHEN x IS NULL THEN b WHEN x = 'Unsure' THEN b WHEN c <> 'unsure' AND x = b THEN x WHEN y = 'Unsure' THEN b WHEN y = x THEN x ELSE b END AS bin,
    CASE WHEN x IS NULL THEN c WHEN x = 'Unsure' THEN 'unsure' WHEN c <> 'unsure' AND x = b THEN 'high' WHEN y = 'Unsure' THEN 'unsure' WHEN y = x THEN 'high' ELSE 'low' END AS confidence FROM a"""
)
def model_agreement(spark, sf_dir):
    t = _tagged(spark, sf_dir).select("id", "hit.bin", "hit.confidence")
    x = F.when(F.col("id") % 4 == 1, F.col("bin")).when(F.col("id") % 4 == 2, "_Images").when(F.col("id") % 4 == 3, "Unsure")
    y = F.when(F.col("id") % 3 == 1, "_Images").when(F.col("id") % 3 == 2, "Unsure")
    return t.select("id", sniff.combine(F.col("bin"), F.col("confidence"), x, y).alias("c")).select("id", "c.*")


@query(f"WITH {V} SELECT id, CASE WHEN count(*) OVER (PARTITION BY sha256, size) > 1 THEN 'cg-' || left(sha256, 12) END AS copy_group FROM v_files")
def copy_groups(spark, sf_dir):
    return dedupe.copy_groups(views.files(spark, sf_dir)).select("id", "copy_group")


@query(f"WITH {V} SELECT 'cg-' || left(sha256, 12) AS copy_group, arg_min(relpath, (length(path), mtime, lower(path))) AS keeper FROM v_files GROUP BY sha256, size HAVING count(*) > 1")
def copy_keepers(spark, sf_dir):
    items = dedupe.copy_groups(views.files(spark, sf_dir)).withColumn("abs", F.col("path")).withColumn("rel", F.col("relpath"))
    return dedupe.copy_keepers(items)


BURST_SQL = """WITH e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS p, lpad(CAST(event_id AS VARCHAR), 10, '0') AS rel, epoch(ts) AS t FROM events),
  g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600 THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY p ORDER BY t, rel)),
  r AS (SELECT *, sum(cut) OVER (PARTITION BY p ORDER BY t, rel ROWS UNBOUNDED PRECEDING) AS run FROM g),
  s AS (SELECT *, count(*) OVER (PARTITION BY p, run) AS n FROM r), k AS (SELECT p, run, row_number() OVER (PARTITION BY p ORDER BY run) - 1 AS idx FROM (SELECT DISTINCT p, run FROM s WHERE n > 1)),
  b AS (SELECT s.id, s.p, s.n AS burst_size, CASE WHEN k.idx IS NULL THEN 'dir:' || s.p ELSE 'burst:' || s.p || ':' || CAST(k.idx AS VARCHAR) END AS batch FROM s LEFT JOIN k ON s.p = k.p AND s.run = k.run)"""


def _bursts(spark, sf_dir):
    t = views.touches(spark, sf_dir).withColumn("mtime", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return tagging.bursts(t, seconds=3600)


@query(BURST_SQL + " SELECT id, batch, burst_size FROM b")
def bursts(spark, sf_dir):
    return _bursts(spark, sf_dir).select("id", "batch", "burst_size")


@query(BURST_SQL + " SELECT batch, count(*) AS members FROM b GROUP BY batch HAVING count(*) > 2")
def burst_counts(spark, sf_dir):
    return _bursts(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("members")).filter("members > 2")


@query(TAG_SQL + ", b AS (SELECT *, id // 3 AS batch FROM r) SELECT batch, count(*) AS members, bool_and(hit[2] = 'high') AND min(hit[1]) = max(hit[1]) AS approved FROM b GROUP BY batch")
def batch_vote(spark, sf_dir):
    t = _tagged(spark, sf_dir).select(F.floor(F.col("id") / 3).alias("batch"), "hit.bin", "hit.confidence")
    return tagging.batch_votes(t)


TAG_PLAN_SQL = TAG_SQL + """,
  i AS (SELECT id, CAST(id AS VARCHAR) AS rel, '/in/' || CAST(id % 9 AS VARCHAR) || '/' || CASE WHEN id % 11 = 0 THEN 'Dungeon-Map' ELSE 'file' END || CAST(id % 200 AS VARCHAR) || ext AS abs, hit[1] AS bin, CASE WHEN id % 5 = 0 THEN hit[2] ELSE 'high' END AS confidence, id // 2 AS batch, CAST(id AS DOUBLE) AS mtime,
    CASE WHEN count(*) OVER (PARTITION BY d.text) > 1 THEN 'cg-' || left(sha256(d.text), 12) END AS cg FROM r JOIN documents d ON d.doc_id = r.id),
  v AS (SELECT batch, count(*) AS members, bool_and(confidence = 'high') AND min(bin) = max(bin) AS ok FROM i GROUP BY batch),
  k AS (SELECT cg, arg_min(rel, (length(abs), mtime, lower(abs))) AS keeper FROM i WHERE cg IS NOT NULL GROUP BY cg),
  a AS (SELECT i.*, ok, members, keeper, CASE WHEN ok THEN '/out/' || bin || '/' || regexp_extract(abs, '[^/]*$') END AS dst FROM i JOIN v USING (batch) LEFT JOIN k USING (cg)),
  p AS (SELECT *, CASE WHEN NOT ok THEN 'review' WHEN keeper <> rel THEN 'recycle' ELSE 'move' END AS p0, CASE WHEN NOT ok THEN CASE WHEN members = 1 THEN CASE WHEN confidence <> 'high' THEN 'not high confidence' ELSE 'unknown bin' END ELSE 'batch held: not all members are sure of the same bin' END END AS r0 FROM a),
  q AS (SELECT *, p0 = 'move' AND count(*) FILTER (p0 = 'move') OVER (PARTITION BY lower(dst)) > 1 AS clash FROM p),
  s AS (SELECT *, CASE WHEN clash THEN 'review' ELSE p0 END AS p1, CASE WHEN clash THEN 'destination collision in plan' ELSE r0 END AS r1 FROM q),
  z AS (SELECT s.rel, CASE WHEN s.p1 = 'recycle' AND m.rel IS NULL THEN 'review' ELSE s.p1 END AS proposal, CASE WHEN s.p1 = 'recycle' AND m.rel IS NULL THEN 'extra copy; original was not moved' ELSE s.r1 END AS reason, s.dst FROM s LEFT JOIN s m ON m.rel = s.keeper AND m.p1 = 'move')"""


def _plan(spark, sf_dir):
    t = _tagged(spark, sf_dir)
    items = dedupe.copy_groups(t).select(
        F.col("id").cast("string").alias("rel"),
        F.concat(F.lit("/in/"), F.col("id") % 9, F.lit("/"), F.when(F.col("id") % 11 == 0, "Dungeon-Map").otherwise("file"), F.col("id") % 200, F.col("ext")).alias("abs"),
        F.col("hit.bin").alias("bin"), F.when(F.col("id") % 5 == 0, F.col("hit.confidence")).otherwise("high").alias("confidence"), F.floor(F.col("id") / 2).alias("batch"), "copy_group", F.col("id").cast("double").alias("mtime"),
    )
    return tagging.plan(items, "/out")


@query(TAG_PLAN_SQL + " SELECT * FROM z")
def tag_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(TAG_PLAN_SQL + " SELECT reason, count(*) AS n FROM z WHERE proposal = 'review' GROUP BY reason")
def review_reasons(spark, sf_dir):
    return _plan(spark, sf_dir).filter("proposal = 'review'").groupBy("reason").agg(F.count("*").alias("n"))


@query(TAG_PLAN_SQL + " SELECT proposal || '-' || lpad(CAST(row_number() OVER (PARTITION BY proposal ORDER BY rel) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (PARTITION BY proposal ORDER BY rel) AS VARCHAR))) AS INT), '0') AS id, proposal AS op, rel, dst FROM z WHERE proposal IN ('move', 'recycle')")
def tag_actions(spark, sf_dir):
    return tagging.numbered_actions(_plan(spark, sf_dir))


PARTS_SQL = """WITH o AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS tok, p_size AS px FROM part WHERE p_partkey % 2 = 0),
  c AS (SELECT p_partkey AS id, list_concat(list_concat(string_split(lower(p_name), ' ')[1:1], [chr(CAST(97 + p_partkey % 5 AS INT))]), string_split(lower(p_name), ' ')[2:]) AS tok, p_size // 2 AS px, 'p/' || CAST(p_partkey AS VARCHAR) AS path FROM part),
  x AS (SELECT o.id AS overview_id, c.id AS part_id, c.tok[2] AS marker, c.px AS pixels, c.path, o.px AS total FROM o JOIN c ON list_concat(c.tok[1:1], c.tok[3:]) = o.tok AND c.px < o.px AND c.id <> o.id),
  w AS (SELECT overview_id, marker, total, arg_min(part_id, (-pixels, length(path), lower(path))) AS part_id, arg_min(pixels, (-pixels, length(path), lower(path))) AS pixels, arg_min(path, (-pixels, length(path), lower(path))) AS path, count(*) - 1 AS losers FROM x GROUP BY ALL)"""


def _parts(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    words = F.split(F.lower("p_name"), " ")
    over = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("").alias("set_dir"), words.alias("tokens"), F.col("p_size").alias("pixels"))
    letter = F.char(97 + F.col("p_partkey") % 5)
    cand = p.select(F.col("p_partkey").alias("id"), F.lit("").alias("set_dir"), F.concat(F.slice(words, 1, 1), F.array(letter), F.slice(words, 2, 99)).alias("tokens"), F.floor(F.col("p_size") / 2).cast("int").alias("pixels"), F.concat(F.lit("p/"), F.col("p_partkey")).alias("path"))
    return over, cand


@query(PARTS_SQL + " SELECT * FROM x")
def part_matches(spark, sf_dir):
    return parts.matches(*_parts(spark, sf_dir))


@query(PARTS_SQL + " SELECT * FROM w")
def marker_collapse(spark, sf_dir):
    return parts.collapse(*_parts(spark, sf_dir))


@query(
    PARTS_SQL
    + """, r AS (SELECT *, {'p': -pixels, 'n': length(path), 'l': lower(path), 'path': path} AS rk FROM x),
    b AS (SELECT *, min(rk) OVER (PARTITION BY overview_id, marker ORDER BY part_id ROWS UNBOUNDED PRECEDING) AS best FROM r),
    h AS (SELECT *, CASE WHEN best.path <> path THEN best.path ELSE first(CASE WHEN best.path = path THEN path END IGNORE NULLS) OVER (PARTITION BY overview_id, marker ORDER BY part_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS kept_path FROM b)
    SELECT overview_id, marker, path, kept_path FROM h WHERE kept_path IS NOT NULL"""
)
def marker_losers(spark, sf_dir):
    return parts.losers(*_parts(spark, sf_dir))


@query(
    PARTS_SQL
    + """, k AS (SELECT overview_id, list_sort(list(marker)) AS m, sum(pixels) AS covered FROM w GROUP BY overview_id), j AS (SELECT o.id AS overview_id, coalesce(m, []) AS m, CASE WHEN px > 0 THEN coalesce(covered, 0) * 100.0 / px ELSE 0 END AS raw FROM o LEFT JOIN k ON k.overview_id = o.id)
    SELECT overview_id, len(m) AS n_parts, CASE WHEN len(m) = 0 THEN '-' ELSE array_to_string(m, '') END AS markers, CAST(round_even(raw, 0) AS INT) AS area,
    CASE WHEN len(m) = 0 THEN 'no' WHEN raw >= 80 OR (len(m) >= 2 AND m[1] = 'a' AND ascii(m[-1]) - 96 = len(m)) THEN 'yes' ELSE 'partial' END AS found FROM j"""
)
def parts_found(spark, sf_dir):
    return parts.verdicts(*_parts(spark, sf_dir))


@query("SELECT p_partkey AS id, p_size * 1000000 > 20000000 OR p_retailprice * 1048576 > 1500 * 1048576.0 AS over FROM part")
def oversize(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parts.over_threshold(F.col("p_retailprice") * 2**20, F.col("p_size") * 1_000_000, 1500, 20).alias("over"))


NAMES = ("a.zip.001", "a.zip.002", "a.part1.rar", "name.part01.rar", "a.z01", "map.z02", "map.zip", "Office Part 2.zip", "Map (Part 2).zip", "dungeon_pt1.zip", "a.zip.partial", "a.zip.bad2", "a.zip.part1", "Map Pack #1.zip")
NAMES_SQL = "WITH s AS (SELECT doc_id AS id, [" + ",".join(f"'{n}'" for n in NAMES) + "][doc_id % 14 + 1] AS name FROM documents)"
BASES = {"a.zip.001": ("numeric", "a.zip", 1), "a.zip.002": ("numeric", "a.zip", 2), "a.part1.rar": ("rar_part", "a.rar", 1), "name.part01.rar": ("rar_part", "name.rar", 1), "a.z01": ("zip_z", "a.zip", 1), "map.z02": ("zip_z", "map.zip", 2), "Office Part 2.zip": ("named_part", "Office.zip", 2), "Map (Part 2).zip": ("named_part", "Map.zip", 2), "dungeon_pt1.zip": ("named_part", "dungeon.zip", 1)}


@query(NAMES_SQL + ", k(name, scheme, base, idx) AS (VALUES " + ",".join(f"('{n}','{s}','{b}',{i})" for n, (s, b, i) in BASES.items()) + ") SELECT id, scheme, base, CAST(idx AS INT) AS index, scheme = 'numeric' AS concat FROM s LEFT JOIN k USING (name)")
def split_volumes(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 14 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), names.split_volume(name).alias("s")).select("id", "s.scheme", "s.base", "s.index", "s.concat")


@query(f"WITH {V}, n AS (SELECT id, replace(relpath, 'f', CASE WHEN id % 3 = 0 THEN 'CON ' ELSE 'a' END) AS p FROM v_files) SELECT id, len(list_filter(string_split(p, '/'), lambda x: contains(x, ' '))) AS spaces FROM n")
def name_lint(spark, sf_dir):
    f = views.files(spark, sf_dir)
    p = F.replace(F.col("relpath"), F.lit("f"), F.when(F.col("id") % 3 == 0, "CON ").otherwise("a"))
    return f.select("id", F.size(F.filter(names.lint(p, F.lit("generic")), lambda w: w == "spaces")).alias("spaces"))


@query(f"WITH {V} SELECT id, CASE WHEN id % 6 = 0 THEN 'traversal' WHEN id % 6 = 1 THEN 'absolute' WHEN id % 6 = 2 THEN 'drive' END AS reason FROM v_files")
def archive_names(spark, sf_dir):
    f = views.files(spark, sf_dir)
    name = F.when(F.col("id") % 6 == 0, F.concat(F.lit("a/../"), F.col("relpath"))).when(F.col("id") % 6 == 1, F.concat(F.lit("/"), F.col("relpath"))).when(F.col("id") % 6 == 2, F.concat(F.lit("C:"), F.col("relpath"))).otherwise(F.col("relpath"))
    return f.select("id", paths.archive_member_reason(name).alias("reason"))


@query("SELECT p_partkey AS id, CASE WHEN p_retailprice >= 1024 THEN printf('%.1f KB', p_retailprice / 1024) ELSE CAST(CAST(trunc(p_retailprice) AS BIGINT) AS VARCHAR) || ' B' END AS human FROM part")
def human_bytes(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.human_bytes(F.col("p_retailprice")).alias("human"))


@query("WITH r AS (SELECT l_orderkey AS sheet, CAST(l_linenumber * 7 % 20 AS BIGINT) AS x, CAST(l_partkey % 15 AS BIGINT) AS y, CAST(1 + l_suppkey % 9 AS BIGINT) AS w, CAST(1 + trunc(l_quantity) % 7 AS BIGINT) AS h FROM lineitem), c AS (SELECT sheet, y, h, unnest(range(x, least(x + w, 25))) AS cx FROM r), d AS (SELECT DISTINCT sheet, cx, unnest(range(y, least(y + h, 18))) AS cy FROM c) SELECT sheet, count(*) AS area FROM d GROUP BY sheet")
def union_area(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")
    r = l.select(F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") * 7 % 20).cast("bigint").alias("x"), (F.col("l_partkey") % 15).alias("y"), (1 + F.col("l_suppkey") % 9).alias("w"), (1 + F.col("l_quantity").cast("bigint") % 7).alias("h"))
    return geometry.union_area(r, "sheet", 25, 18).filter("area > 0")


@query("WITH r AS (SELECT l_orderkey AS sheet, l_linenumber AS id, CAST(l_linenumber * 7 % 20 AS BIGINT) AS x, CAST(l_partkey % 15 AS BIGINT) AS y, CAST(1 + l_suppkey % 9 AS BIGINT) AS w, CAST(1 + trunc(l_quantity) % 7 AS BIGINT) AS h FROM lineitem) SELECT a.sheet, a.id AS a, b.id AS b FROM r a JOIN r b ON a.sheet = b.sheet AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def overlaps(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")
    r = l.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 7 % 20).cast("bigint").alias("x"), (F.col("l_partkey") % 15).alias("y"), (1 + F.col("l_suppkey") % 9).alias("w"), (1 + F.col("l_quantity").cast("bigint") % 7).alias("h"))
    return geometry.overlapping(r, "sheet")


@query("SELECT l_orderkey AS sheet, median(l_quantity) AS middle, max(abs(l_quantity - m) / m) AS spread FROM (SELECT l_orderkey, l_quantity, median(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY l_orderkey")
def median_spread(spark, sf_dir):
    return geometry.median_spread(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_quantity").alias("v")), "sheet").withColumnRenamed("median", "middle")


@query(
    """WITH RECURSIVE v AS (SELECT l_orderkey AS sheet, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i FROM lineitem),
    c AS (SELECT sheet, i, v AS s, 1 AS n, 0 AS k FROM v WHERE i = 1
      UNION ALL SELECT v.sheet, v.i, CASE WHEN v.v - s / n <= 3 THEN s + v.v ELSE v.v END, CASE WHEN v.v - s / n <= 3 THEN n + 1 ELSE 1 END, CASE WHEN v.v - s / n <= 3 THEN k ELSE k + 1 END FROM c JOIN v ON v.sheet = c.sheet AND v.i = c.i + 1)
    SELECT sheet, list(m ORDER BY k) AS centers FROM (SELECT sheet, k, arg_max(s / n, n) AS m FROM c GROUP BY sheet, k) GROUP BY sheet"""
)
def running_clusters(spark, sf_dir):
    """Running-mean clusters."""
    l = views.table(spark, sf_dir, "lineitem")
    return geometry.clusters(l.select(F.col("l_orderkey").alias("sheet"), F.col("l_quantity").alias("v")), "sheet", 3.0)


@query(
    """WITH c AS (SELECT l_orderkey AS sheet, (l_linenumber - 1) % 3 AS x, (l_linenumber - 1) // 3 AS y, l_linenumber - 1 AS v FROM lineitem),
    s AS (SELECT sheet, max(x) + 1 AS cols, max(y) + 1 AS rows, count(*) AS n FROM c GROUP BY sheet),
    f AS (SELECT sheet, cols, rows, n, min(v - y * cols - x) AS lo_r, max(v - y * cols - x) AS hi_r, min(v - x * rows - y) AS lo_c, max(v - x * rows - y) AS hi_c FROM c JOIN s USING (sheet) GROUP BY ALL),
    k AS (SELECT *, lo_r = hi_r AND lo_r >= 0 AND lo_r + cols * rows - 1 <= 25 AS r, lo_c = hi_c AND lo_c >= 0 AND lo_c + cols * rows - 1 <= 25 AS c FROM f),
    o AS (SELECT *, CASE WHEN r AND c THEN CASE WHEN (cols = 1 OR rows = 1) AND n = cols * rows THEN 'row' END WHEN r THEN 'row' WHEN c THEN 'col' END AS "order" FROM k)
    SELECT sheet, "order", CASE "order" WHEN 'row' THEN lo_r WHEN 'col' THEN lo_c END AS first FROM o"""
)
def lattice_cells(spark, sf_dir):
    """Reading order of cells on a lattice."""
    l = views.table(spark, sf_dir, "lineitem")
    cells = l.select(F.col("l_orderkey").alias("sheet"), ((F.col("l_linenumber") - 1) % 3).alias("col"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("row"), F.char(F.lit(96) + F.col("l_linenumber")).alias("marker"))
    return geometry.reading_order(cells, "sheet")
