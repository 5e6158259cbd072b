"""Numbers over crowded groups, and what is built on them."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import numbering, staging, tagging

ROWS = 300_000


@pytest.fixture(scope="module")
def crowded(spark):
    """Three destinations; one holds two thirds of the rows."""
    dest = F.when(F.col("id") % 3 < 2, "a/hot.txt").when(F.col("id") % 6 == 2, "a/b.txt").otherwise("c.txt")
    return spark.range(0, ROWS, numPartitions=9).select("id", dest.alias("dest"), F.sha2(F.col("id").cast("string"), 256).alias("other"))


def test_numbers_are_whole_and_in_order(spark, crowded):
    got = numbering.numbered(crowded, ["dest"], ["other"])
    assert got.columns == ["id", "dest", "other", "number"]
    groups = got.groupBy("dest").agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("low"), F.max("number").alias("high")).collect()
    assert sum(g.n for g in groups) == ROWS and all(g.n == g.d == g.high and g.low == 1 for g in groups)
    rows = got.filter("dest = 'a/b.txt'").orderBy("number").select("other").toPandas()["other"].tolist()
    assert rows == sorted(rows)


def test_numbers_with_nulls_ties_and_no_rows(spark):
    frame = spark.createDataFrame([(None, 2), (None, None), ("x", 1), ("x", 1), (None, 1)], "g string, o int")
    got = sorted((r.g or "", r.o or 0, r.number) for r in numbering.numbered(frame, ["g"], ["o"]).collect())
    assert got == [("", 0, 1), ("", 1, 2), ("", 2, 3), ("x", 1, 1), ("x", 1, 2)]
    assert numbering.numbered(frame.limit(0), ["g"], ["o"]).count() == 0


def test_versions_of_a_crowded_destination(spark, crowded):
    taken = spark.createDataFrame([("a/hot.txt",), ("a/hot_v3.txt",)], "dest string")
    got = staging.versions(crowded.drop("other"), taken, most=ROWS)
    assert got.agg(F.count("*"), F.countDistinct("final"), F.count("final")).first() == (ROWS, ROWS, ROWS)
    first = {r.id: r.final for r in got.filter("id < 6").collect()}
    assert first == {0: "a/hot_v2.txt", 1: "a/hot_v4.txt", 2: "a/b.txt", 3: "a/hot_v5.txt", 4: "a/hot_v6.txt", 5: "c.txt"}


def test_ids_of_many_actions(spark):
    planned = spark.range(0, ROWS, numPartitions=9).select(F.format_string("p/%06d", "id").alias("rel"), F.when(F.col("id") % 10 == 0, "recycle").otherwise("move").alias("proposal"), F.lit("d").alias("dst"))
    got = tagging.numbered_actions(planned)
    assert got.agg(F.count("*"), F.countDistinct("id")).first() == (ROWS, ROWS)
    last = got.filter("op = 'recycle'").orderBy(F.desc("rel")).first()
    assert (last.id, last.rel) == ("recycle-30000", "p/299990")
