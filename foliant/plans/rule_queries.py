"""Queries over rules that are compiled or searched: schemas, containment, stand-ins, orders of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_schema
from ..operators import containment, geometry, locate, parts
from . import views
from .registry import query

TURN_SCHEMA = {
    "type": "object",
    "required": ["id", "role", "text"],
    "properties": {
        "id": {"$ref": "#/$defs/id"},
        "role": {"enum": ["user", "assistant"]},
        "text": {"type": "string", "maxLength": 200},
        "turn": {"type": "integer", "maximum": 3},
        "tags": {"type": "array", "minItems": 1, "items": {"anyOf": [{"const": 0}, {"type": "string", "pattern": "^[a-z]+$"}]}},
    },
    "additionalProperties": False,
    "if": {"properties": {"role": {"const": "user"}}},
    "then": {"properties": {"turn": {"oneOf": [{"const": 0}, {"minimum": 2}]}}},
    "else": {"allOf": [{"required": ["note"]}]},
    "$defs": {"id": {"type": "integer", "minimum": 2}},
}


@query(
    """WITH c AS (SELECT conv_id, turn, role, length(text) AS n, conv_id % 3 AS k FROM conversations),
    e AS (SELECT conv_id, turn, list_filter([
      CASE WHEN conv_id < 2 THEN '$.id: out of bounds' END, CASE WHEN role NOT IN ('user', 'assistant') THEN '$.role: not in enum' END, CASE WHEN n > 200 THEN '$.text: length ' || n END, CASE WHEN turn > 3 THEN '$.turn: out of bounds' END,
      CASE WHEN k = 0 THEN '$.tags: length 0' END, CASE WHEN k = 1 THEN '$.tags[0]: fits none' END, CASE WHEN k = 1 THEN '$.tags[2]: fits none' END, CASE WHEN k = 2 THEN '$.extra: unknown' END,
      CASE WHEN role = 'user' AND turn = 1 THEN '$.turn: fits not exactly one' END, CASE WHEN role <> 'user' THEN '$.note: missing' END], lambda x: x IS NOT NULL) AS found FROM c)
    SELECT conv_id, turn, array_to_string(list_sort(found), '; ') AS errors FROM e"""
)
def schema_check(spark, sf_dir):
    """Turns as JSON documents against a schema with references, branches and combinators."""
    c = views.table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 3
    tags = F.when(k == 0, "[]").when(k == 1, '["Ab","ok",1]').otherwise('[0,"ok"]')
    extra = F.when(k == 2, ',"extra":null').otherwise("")
    text = F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit(',"tags":'), tags, extra, F.lit(","), F.substring(F.to_json(F.struct("role", "text")), 2, 2_000_000_000))
    return c.select("conv_id", "turn", F.array_join(F.array_sort(json_schema.json_errors(text, TURN_SCHEMA)), "; ").alias("errors"))


@query(
    f"""WITH {views.FILES_SQL}, roots AS (SELECT DISTINCT '/data/' || source_name || '/' || upper(lang) || '/' AS root FROM v_base JOIN v_files ON id = doc_id UNION SELECT DISTINCT '/data/' || source_name FROM v_files)
    SELECT root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM v_files JOIN roots ON lower(path) = rtrim(lower(root), '/') OR starts_with(lower(path), rtrim(lower(root), '/') || '/') GROUP BY root"""
)
def root_totals(spark, sf_dir):
    """Files and bytes in each of many roots, some inside others."""
    files = views.files(spark, sf_dir)
    roots = files.select(F.concat(F.lit("/data/"), "source_name", F.lit("/"), F.upper("group_name"), F.lit("/")).alias("root")).union(files.select(F.concat(F.lit("/data/"), "source_name"))).distinct()
    return containment.holding(files.select("path", "size"), roots).groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(
    f"""WITH {views.FILES_SQL}, f AS (SELECT id, regexp_replace(path, '/[^/]*$', '') AS folder FROM v_files),
    r AS (SELECT DISTINCT folder AS root, CASE WHEN len(string_split(folder, '/')) % 2 = 0 THEN 'source' ELSE 'destination' END AS role FROM f)
    SELECT o.root AS outer, o.role AS outer_role, i.root AS inner, i.role AS inner_role FROM r o JOIN r i ON o.root <> i.root AND starts_with(lower(i.root) || '/', lower(o.root) || '/')""".replace(" AS outer,", ' AS "outer",').replace(" AS inner,", ' AS "inner",')
)
def root_overlaps(spark, sf_dir):
    """Folders of the inventory as sources and destinations: which lie in which."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    roots = views.files(spark, sf_dir).select(folder.alias("root")).distinct().withColumn("role", F.when(F.size(F.split("root", "/")) % 2 == 0, "source").otherwise("destination"))
    return containment.overlaps(roots)


@query(
    f"""WITH {views.FILES_SQL}, f AS (SELECT id, ext, size, CAST(100 + id * 37 % 9000 AS BIGINT) AS width, CAST(100 + id * 91 % 7000 AS BIGINT) AS height, CAST(1 + size // (1 + id % 50) AS BIGINT) AS cap FROM v_files),
    e AS (SELECT unnest([8000, 4000, 2000, 1600, 1200, 800, 400, 200, 100, 64, 32]) AS edge), q AS (SELECT unnest([90, 70, 50, 30, 15, 5]) AS quality),
    t AS (SELECT id, cap, edge, quality, CAST(floor(size * least(1.0::DOUBLE, edge / greatest(width, height)) * least(1.0::DOUBLE, edge / greatest(width, height)) * CASE WHEN ext = '.png' THEN 1.0::DOUBLE ELSE quality / 100.0::DOUBLE END) AS BIGINT) AS bytes FROM f, e, q WHERE ext <> '.png' OR quality = 90),
    b AS (SELECT id, arg_min({{'edge': edge, 'quality': quality, 'bytes': bytes}}, (-edge, -quality)) AS b FROM t WHERE bytes <= cap GROUP BY id)
    SELECT f.id, b.edge AS edge, b.quality AS quality, b.bytes AS bytes FROM f LEFT JOIN b USING (id)"""
)
def standin_first_fit(spark, sf_dir):
    """The first edge and quality at which a file's stand-in is under its cap; the SQL tries the whole grid."""
    f = views.files(spark, sf_dir).select("id", "ext", "size", (100 + F.col("id") * 37 % 9000).alias("width"), (100 + F.col("id") * 91 % 7000).alias("height"), (1 + F.floor(F.col("size") / (1 + F.col("id") % 50))).alias("cap"))
    return parts.standin_choice(f).select("id", "edge", "quality", "bytes")


_CELLS = """SELECT l_orderkey AS sheet, (l_linenumber - 1) % 3 AS col, (l_linenumber - 1) // 3 AS row, least(3, max(l_linenumber) OVER w) AS cols, (max(l_linenumber) OVER w + 2) // 3 AS rows FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)"""


@query(
    f"""WITH c AS ({_CELLS}), v AS (SELECT *, CASE sheet % 4 WHEN 0 THEN sheet % 5 + row * cols + col WHEN 1 THEN sheet % 7 + 1 + col * rows + row WHEN 2 THEN (row * 3 + col) * (row * 3 + col) % 26 ELSE sheet % 30 + row * cols + col END AS value, sheet % 4 = 1 AS digits FROM c),
    f AS (SELECT sheet, col, row, value, digits, max(col) OVER w + 1 AS cols, max(row) OVER w + 1 AS rows FROM v WHERE digits OR value < 26 WINDOW w AS (PARTITION BY sheet)),
    m AS (SELECT *, value - (row * cols + col) AS r, value - (col * rows + row) AS k FROM f),
    s AS (SELECT sheet, bool_or(digits) AS digits, any_value(cols) AS cols, any_value(rows) AS rows, count(*) AS n, min(r) AS r0, max(r) AS r1, min(k) AS k0, max(k) AS k1 FROM m GROUP BY sheet),
    o AS (SELECT *, coalesce(r0 = r1 AND r0 >= digits::INT AND r0 + cols * rows - 1 <= CASE WHEN digits THEN 99 ELSE 25 END, false) AS by_row, coalesce(k0 = k1 AND k0 >= digits::INT AND k0 + cols * rows - 1 <= CASE WHEN digits THEN 99 ELSE 25 END, false) AS by_col FROM s),
    d AS (SELECT *, CASE WHEN by_row AND by_col THEN CASE WHEN (cols = 1 OR rows = 1) AND n = cols * rows THEN 'row' END WHEN by_row THEN 'row' WHEN by_col THEN 'col' END AS ord FROM o)
    SELECT sheet, ord AS "order", CASE ord WHEN 'row' THEN r0 WHEN 'col' THEN k0 END AS first FROM d"""
)
def reading_orders(spark, sf_dir):
    """Lines of an order as cells of a sheet, with letters or numbers as markers."""
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") - 1).cast("bigint").alias("i"))
    most = lines.groupBy("sheet").agg((F.max("i") + 1).alias("n"))
    c = lines.join(most, "sheet").select("sheet", "i", (F.col("i") % 3).alias("col"), F.floor(F.col("i") / 3).alias("row"), F.least(F.lit(3), "n").alias("cols"), F.floor((F.col("n") + 2) / 3).alias("rows"))
    kind = F.col("sheet") % 4
    row, col = F.col("row"), F.col("col")
    value = (
        F.when(kind == 0, F.col("sheet") % 5 + row * F.col("cols") + col).when(kind == 1, F.col("sheet") % 7 + 1 + col * F.col("rows") + row)
        .when(kind == 2, F.col("i") * F.col("i") % 26).otherwise(F.col("sheet") % 30 + row * F.col("cols") + col)
    )
    marked = c.withColumn("value", value).filter((kind == 1) | (F.col("value") < 26)).withColumn("marker", F.when(kind == 1, F.col("value").cast("string")).otherwise(F.char(F.col("value") + 97)))
    return geometry.reading_order(marked.select("sheet", "col", "row", "marker"), "sheet")


@query(
    """WITH l AS (SELECT l_orderkey AS sheet, l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS BIGINT) AS x, CAST(l_discount * 100 AS BIGINT) AS y, l_returnflag AS flag FROM lineitem),
    p AS (SELECT sheet, part, n * 1000000 + part AS ord, CASE WHEN part % 3 = 0 THEN -1 ELSE n END AS idx, x, y FROM l WHERE flag <> 'R'), c AS (SELECT sheet, n AS cell, x, y FROM l WHERE flag = 'R')
    SELECT sheet, cell, arg_min(part, (CASE WHEN idx < 0 THEN abs(p.x - c.x) + abs(p.y - c.y) ELSE abs(cell - idx) END, ord)) AS sibling FROM c JOIN p USING (sheet) GROUP BY sheet, cell"""
)
def nearest_siblings(spark, sf_dir):
    """Returned lines as missing cells, the other lines of their order as parts, some without an index."""
    l = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("x"), F.round(F.col("l_discount") * 100).cast("bigint").alias("y"), "l_returnflag")
    index = F.when(F.col("part") % 3 == 0, -1).otherwise(F.col("n"))
    located = l.filter("l_returnflag <> 'R'").select("sheet", "part", index.alias("part_index"), (F.col("n") * 1_000_000 + F.col("part")).alias("part_order"), "x", "y")
    return geometry.nearest_sibling(l.filter("l_returnflag = 'R'").select("sheet", F.col("n").alias("cell"), F.col("n").alias("cell_index"), "x", "y"), located, "sheet")


@query("SELECT doc_id AS sheet, doc_id % 21 AS x, doc_id % (15 + doc_id % 40) AS y, 12 AS w, 10 AS h, true AS sure FROM documents")
def located_parts(spark, sf_dir):
    """A sheet of pixels for each document (digests of its id, a row each) and a piece of it, found again."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", (24 + F.col("doc_id") % 40).cast("int").alias("height"))
    row = lambda n: F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), n.cast("string")), 256)
    x, y = F.col("doc_id") % 21, (F.col("doc_id") % (F.col("height") - 9)).cast("int")
    joined = lambda first, last, cut: F.unhex(F.array_join(F.transform(F.sequence(first, last), cut), ""))
    sheet = F.col("doc_id").cast("string").alias("sheet")
    whole = d.select(sheet, F.lit(32).alias("width"), "height", joined(F.lit(0), F.col("height") - 1, row).alias("pixels"))
    cut = joined(y, y + 9, lambda n: F.substring(row(n), (2 * x + 1).cast("int"), F.lit(24)))
    piece = d.select(sheet, F.lit("p").alias("part"), F.lit(12).alias("width"), F.lit(10).alias("height"), cut.alias("pixels"))
    hits = locate.located(whole, piece)
    return hits.select(F.col("sheet").cast("bigint").alias("sheet"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "w", "h", locate.is_sure(F.col("score"), F.col("margin")).alias("sure"))
