"""The driver's tables in the roles of the engine's own, for its queries; each view has its DuckDB form beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

EXTENSIONS = (".png", ".jpg", ".txt", ".pdf", ".zip", ".docx", ".exe", ".bin")
LAYOUTS = ("keep_relpath", "by_year", "by_year_month", "pack_tree")
EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, *, content: bool = False) -> DataFrame:
    """Documents as an inventory; digests are left out when unused, since no action needs them then."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    name = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("string"), ext)
    month = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    folder = (
        F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", "lang", "source"))
        .when(F.col("doc_id") % 5 == 1, F.concat_ws("/", F.lit("2024"), month, "lang"))
        .when(F.col("doc_id") % 5 == 2, F.concat_ws("/", F.lit("2024-03"), "lang", "source", F.lit("deep")))
        .when(F.col("doc_id") % 5 == 3, F.concat_ws("/", F.lit("20240115"), "source"))
        .otherwise(F.lit("2023"))
    )
    relpath = F.concat_ws("/", folder, name)
    where = paths.bundle_and_pack(relpath)
    mtime = (F.lit(EPOCH) + F.col("doc_id") * 977 % 31_536_000).cast("double")
    out = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_name"), number.alias("priority"), F.element_at(F.array(*map(F.lit, LAYOUTS)), number % 4 + 1).alias("layout"), F.col("lang").alias("group_name"),
        F.octet_length("text").cast("bigint").alias("size"), relpath.alias("relpath"), F.concat_ws("/", F.lit("/data"), "source", relpath).alias("path"), ext.alias("ext"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("string")).alias("stem"),
        mtime.alias("mtime"), where["bundle"].alias("bundle"), where["pack"].alias("pack"), where["rest"].alias("from_pack"),
        F.date_format(F.timestamp_seconds(mtime), "yyyy").alias("year"), F.date_format(F.timestamp_seconds(mtime), "MM").alias("month"),
        F.sha2("text", 256).alias("sha256"), F.sha2(F.substring(F.col("text").cast("binary"), 1, 64), 256).alias("prefix64"), F.col("text").alias("content"),
    )
    return out if content else out.drop("content")


#: v_files in DuckDB.
FILES_SQL = """v_base AS (
  SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INT) AS priority,
    (['.png','.jpg','.txt','.pdf','.zip','.docx','.exe','.bin'])[doc_id % 8 + 1] AS ext, 'f' || CAST(doc_id // 4 AS VARCHAR) AS stem,
    CASE doc_id % 5 WHEN 0 THEN lang || '/' || source WHEN 1 THEN '2024/' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '/' || lang
      WHEN 2 THEN '2024-03/' || lang || '/' || source || '/deep' WHEN 3 THEN '20240115/' || source ELSE '2023' END AS folder
  FROM documents),
v_files AS (
  SELECT doc_id AS id, source AS source_name, priority, (['keep_relpath','by_year','by_year_month','pack_tree'])[priority % 4 + 1] AS layout, lang AS group_name,
    CAST(strlen(text) AS BIGINT) AS size, folder || '/' || stem || ext AS relpath, '/data/' || source || '/' || folder || '/' || stem || ext AS path, ext, stem,
    CAST(1704067200 + doc_id * 977 % 31536000 AS DOUBLE) AS mtime,
    CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN lang WHEN 3 THEN source ELSE '_unknown' END AS bundle,
    CASE doc_id % 5 WHEN 0 THEN source WHEN 2 THEN source ELSE '_root' END AS pack,
    CASE doc_id % 5 WHEN 2 THEN 'deep/' || stem || ext ELSE stem || ext END AS from_pack,
    strftime(to_timestamp(1704067200 + doc_id * 977 % 31536000) AT TIME ZONE 'UTC', '%Y') AS year, strftime(to_timestamp(1704067200 + doc_id * 977 % 31536000) AT TIME ZONE 'UTC', '%m') AS month,
    sha256(text) AS sha256, sha256(encode(text)[1:64]) AS prefix64
  FROM v_base)"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a side file: attached if it has a label, else orphaned."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_name"))
    return docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("parent_id")), F.col("id") == F.col("parent_id"), "left")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as archive members."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("inner_path"), F.col("l_quantity").cast("bigint").alias("size"))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that were touched: user is the folder."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("parent_rel"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("rel"), F.col("ts"), "event_type", "value", "props")
