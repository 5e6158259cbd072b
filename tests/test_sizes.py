"""Queries on tables that have what the small ones lack: fractions at a border, ties, many copies."""

import duckdb

from foliant.plans.oracles import ORACLES, QUERIES

from .oracle import compare


def same_as_sql(spark, folder, name, **frames):
    """Write the tables given and run the query and its SQL over them."""
    db = duckdb.connect()
    for table, frame in frames.items():
        frame.toPandas().to_parquet(f"{folder}/{table}.parquet", index=False)
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    compare(spark, db, QUERIES[name], ORACLES[name], str(folder))


def test_size_caps_round_as_their_sql(spark, tmp_path):
    prices = [104857.6, 104857.5, 104858.0, 104857.4, 104858.5, 209715.2, 209715.5, 209716.5, 209714.9, -0.5, 0.5, None]
    rows = [(k * 5 + 1, m, "F", p) for k, p in enumerate(prices) for m in (1, 2, 5, 4)]
    orders = spark.createDataFrame([(i * 10 + m, c, s, p) for m, (i, c, s, p) in enumerate(rows)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    same_as_sql(spark, tmp_path, "size_caps", orders=orders.withColumn("o_orderkey", orders.o_orderkey * 5 + 1))


def test_tier_gates_round_as_their_sql(spark, tmp_path):
    rows = [(1 + 4 * k, 1, "F", p) for k, p in enumerate([0.4, 0.5, 0.6, 1.4, -0.5, -0.6, None])]
    same_as_sql(spark, tmp_path, "tier_gates", orders=spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"))


def test_parts_of_copies_need_no_pairs(spark, tmp_path):
    """Few names, many copies, all totals: the rows are those of the SQL over all pairs."""
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Red "), F.element_at(F.array(*map(F.lit, ("bolt", "ring"))), (F.col("id") % 3 % 2 + 1).cast("int"))).alias("p_name"), (F.hash("id") % 25 + 25).cast("int").alias("p_size"))
    rows = rows.unionByName(spark.createDataFrame([(900, None, 5), (904, "red bolt", 0), (906, "red", 50)], "p_partkey bigint, p_name string, p_size int"))
    folder = tmp_path / "few"
    folder.mkdir()
    for name in ("marker_collapse", "marker_losers", "parts_found", "part_matches"):
        same_as_sql(spark, folder, name, part=rows.withColumn("p_size", F.col("p_size").cast("int")))


def test_collapse_makes_no_pairs(spark):
    """The rows that reach the shuffles of 3,000 copies of one name stay far below their two million pairs."""
    from foliant.operators import parts

    def made(frame):
        frame.collect()
        plan, most, todo = frame._jdf.queryExecution().executedPlan(), 0, []
        todo.append(plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan)
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.finalPhysicalPlan())
            elif "QueryStage" in node.nodeName():
                todo.append(node.plan())
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return most

    over = spark.range(0, 3000, 2).selectExpr("id", "'' AS set_dir", "array('red', 'bolt') AS tokens", "CAST(10 + id % 40 AS int) AS pixels")
    cand = spark.range(3000).selectExpr("id", "'' AS set_dir", "array('red', 'a', 'bolt') AS tokens", "CAST(id % 25 AS int) AS pixels", "concat('p/', id) AS path")
    assert made(parts.collapse(over, cand)) < 100_000 < made(parts.matches(over, cand))
    assert made(parts.verdicts(over, cand)) < 100_000


def test_pairs_of_copies_are_dealt_and_take_little_room(spark, tmp_path):
    """One name with many copies is not one task, and its pairs take little room in files (0.99 byte each before); the rows are all pairs."""
    import glob
    import os

    from pyspark.sql import functions as F

    from foliant.operators import parts

    over = spark.range(0, 1200, 2).selectExpr("id", "'' AS set_dir", "array('red', 'bolt') AS tokens", "CAST(10 + hash(id) % 9 AS int) AS pixels")
    cand = spark.range(10000).selectExpr("id", "'' AS set_dir", "array('red', 'a', 'bolt') AS tokens", "CAST(id % 19 AS int) AS pixels", "concat('p/', id) AS path")
    frame = parts.matches(over, cand).withColumn("task", F.spark_partition_id())
    frame.write.parquet(out := str(tmp_path / "pairs"))
    got = spark.read.parquet(out)
    want = over.alias("o").join(cand.alias("c"), F.expr("c.pixels < o.pixels AND c.id <> o.id")).agg(F.count("*"), F.sum(F.expr("xxhash64(o.id, c.id, 'a', c.pixels, c.path, o.pixels) % 1000003"))).first()
    assert got.agg(F.count("*"), F.sum(F.expr("xxhash64(overview_id, part_id, marker, pixels, path, total) % 1000003"))).first() == want
    each = [r["count"] for r in got.groupBy("task").count().collect()]
    assert len(each) > 1 and max(each) < 0.8 * sum(each)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{out}/*.parquet")) < 0.6 * sum(each)


def shuffles(frame):
    """Exchanges of the plan as it is before anything has run."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_and_parts_meet_once(spark, tmp_path):
    """One join, and the rows of the SQL on sheets of many parts, a few, and none near."""
    rows = [(s, 7 * k % 200, 3 * k % 50, k % 7 + 1) for s, n in ((1, 400), (2, 3), (3, 1)) for k in range(n)]
    items = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")
    same_as_sql(spark, tmp_path, "missing_cells", lineitem=items)
    assert QUERIES["missing_cells"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_references_find_resources_in_their_page(spark, tmp_path):
    """Two exchanges: the pages' own and that of the files; the type decides before the id, the first of equals counts."""
    from foliant.operators import feed

    items = spark.createDataFrame([(k % 5, k % 11) for k in range(200)], "l_orderkey bigint, l_partkey bigint")
    same_as_sql(spark, tmp_path, "page_media", lineitem=items)
    assert shuffles(QUERIES["page_media"](spark, str(tmp_path))) <= 2
    page = '{"data":[{"id":"1","relationships":{"media":{"data":[{"id":"7","type":"media"},{"id":"8","type":"x"},{"id":"9","type":"media"}]}}}],"included":[{"id":"7","type":"other","attributes":{"url":"o"}},{"id":"7","type":"media","attributes":{"url":"m"}},{"id":"7","type":"media","attributes":{"url":"n"}},{"id":"8","type":"media","attributes":{"url":"l"}}]}'
    got = feed.media_of(spark.createDataFrame([("p", page), ("q", None)], "page string, payload string"))
    assert sorted((r.post_id, r.media_id, r.url) for r in got.collect()) == [("1", "7", "m"), ("1", "8", "l")]


def test_zip_contents_takes_the_same_of_equal_paths(spark, tmp_path):
    """Equal paths at the cut: which of them is taken does not hang on the order of the rows."""
    seen = set()
    for n, order in enumerate((1, -1)):
        folder = tmp_path / str(n)
        folder.mkdir()
        items = [(100, 1, float(q)) for q in range(1, 451)][::order]
        spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_quantity double").toPandas().to_parquet(f"{folder}/lineitem.parquet", index=False)
        spark.createDataFrame([(100, "F")], "o_orderkey bigint, o_orderstatus string").toPandas().to_parquet(f"{folder}/orders.parquet", index=False)
        seen.add(tuple(sorted(r["size"] for r in QUERIES["zip_contents"](spark, str(folder)).collect())))
    assert len(seen) == 1


def test_losers_of_copies_are_dealt_and_seen_once(spark, tmp_path):
    """Losers of one name come from several tasks, take little room in files, and no frame is gone through anew for each row; the rows are those of all pairs."""
    import glob
    import os

    from pyspark.sql import functions as F

    from foliant.operators import parts

    over = spark.range(0, 900, 3).selectExpr("id", "'' AS set_dir", "array('red', 'bolt') AS tokens", "CAST(30 AS int) AS pixels")
    cand = spark.range(9000).selectExpr("id", "'' AS set_dir", "array('red', 'a', 'bolt') AS tokens", "CAST(id % 190 / 10 AS int) AS pixels", "concat('p/', id) AS path")
    frame = parts.losers(over, cand)
    assert "unboundedfollowing" not in frame._jdf.queryExecution().optimizedPlan().toString().lower()
    frame.withColumn("task", F.spark_partition_id()).write.parquet(out := str(tmp_path / "lost"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW got AS SELECT overview_id, marker, path, kept_path FROM '{out}/*.parquet'")
    db.execute("""CREATE TABLE want AS WITH x AS (SELECT o.id AS overview_id, c.id AS part_id, CAST(c.id % 190 // 10 AS INT) AS pixels, 'p/' || c.id AS path FROM range(0, 900, 3) o(id), range(9000) c(id) WHERE o.id <> c.id),
        b AS (SELECT *, min({'p': -pixels, 'n': length(path), 'path': path}) OVER w AS best FROM x WINDOW w AS (PARTITION BY overview_id ORDER BY part_id ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT *, CASE WHEN best.path <> path THEN best.path ELSE lead(CASE WHEN best.path = path THEN path END IGNORE NULLS) OVER (PARTITION BY overview_id ORDER BY part_id) END AS kept_path FROM b)
        SELECT overview_id, 'a' AS marker, path, kept_path FROM h WHERE kept_path IS NOT NULL""")
    count = lambda sql: db.sql(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]
    assert count("FROM got") == count("FROM want") > 2_600_000
    assert count("FROM got EXCEPT FROM want") == count("FROM want EXCEPT FROM got") == 0
    each = [n for _, n in db.sql(f"SELECT task, count(*) FROM '{out}/*.parquet' GROUP BY task").fetchall()]
    assert len(each) > 1 and max(each) < 0.8 * sum(each)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{out}/*.parquet")) < 0.6 * sum(each)
