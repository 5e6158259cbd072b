"""Queries over trees of files that Spark writes from the tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventory
from ..operators.tables import shared_dir
from ..sources import walk
from ..sources.storage import resolve
from . import views
from .registry import query


def write_files(rows: DataFrame, base: str) -> None:
    """Files (rel, content) below ``base``, by executors; what is there is written anew under another inode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = resolve(base)
        for batch in batches:
            for rel, content in zip(batch["rel"], batch["content"]):
                name = f"{top}/{rel}"
                system.create_dir(os.path.dirname(name), recursive=True)
                with system.open_output_stream(f"{name}.new") as file:
                    file.write(bytes(content))
                system.move(f"{name}.new", name)
            yield batch[["rel"]]

    rows.select("rel", F.col("content").cast("binary").alias("content")).mapInPandas(run, "rel string").write.format("noop").mode("overwrite").save()


def delete_files(rows: DataFrame, base: str) -> None:
    """Remove files (rel) that ``write_files`` has written below ``base``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = resolve(base)
        for batch in batches:
            for rel in batch["rel"]:
                if system.get_file_info(f"{top}/{rel}").is_file:
                    system.delete_file(f"{top}/{rel}")
            yield batch[["rel"]]

    rows.select("rel").mapInPandas(run, "rel string").write.format("noop").mode("overwrite").save()


def _new_tree(spark) -> str:
    return f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"


@query(
    """WITH f AS (SELECT CASE doc_id % 4 WHEN 0 THEN '_Maps/' || lang || '/_d' || doc_id || '.txt' WHEN 1 THEN source || '/.h' || doc_id WHEN 2 THEN '.git/' || doc_id ELSE source || '/node_modules/' || doc_id END AS rel, strlen(text) AS size, * FROM documents),
    r AS (SELECT 'tree' AS root, rel, 'file' AS kind, size FROM f WHERE doc_id % 4 < 2 UNION ALL
      SELECT DISTINCT 'tree', '_Maps', 'dir', NULL::BIGINT FROM f WHERE doc_id % 4 = 0 UNION ALL SELECT DISTINCT 'tree', '_Maps/' || lang, 'dir', NULL::BIGINT FROM f WHERE doc_id % 4 = 0 UNION ALL
      SELECT DISTINCT 'tree', source, 'dir', NULL::BIGINT FROM f WHERE doc_id % 4 IN (1, 3) UNION ALL SELECT DISTINCT 'tree', '.git', 'excluded', NULL::BIGINT FROM f WHERE doc_id % 4 = 2 UNION ALL
      SELECT DISTINCT 'tree', source || '/node_modules', 'excluded', NULL::BIGINT FROM f WHERE doc_id % 4 = 3 UNION ALL SELECT 'nowhere', '', 'error', NULL::BIGINT)
    SELECT root, rel, kind, size FROM r"""
)
def inventory_walk(spark, sf_dir):
    """A walk over one file for each document, with names that begin with _ and ., excluded folders and a missing root."""
    d = views.table(spark, sf_dir, "documents")
    number, case = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    rel = (
        F.when(case == 0, F.concat(F.lit("_Maps/"), "lang", F.lit("/_d"), number, F.lit(".txt"))).when(case == 1, F.concat("source", F.lit("/.h"), number))
        .when(case == 2, F.concat(F.lit(".git/"), number)).otherwise(F.concat("source", F.lit("/node_modules/"), number))
    )
    base = _new_tree(spark)
    write_files(d.select(rel.alias("rel"), F.col("text").alias("content")), base)
    roots = spark.createDataFrame([(base,), (f"{base}-nowhere",)], "root string")
    return walk.walk(roots).select(F.when(F.col("root") == base, "tree").otherwise("nowhere").alias("root"), "rel", "kind", "size")


@query(
    """WITH one AS (SELECT doc_id, doc_id % 7 || '/' || doc_id AS rel, text FROM documents),
    two AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'moved/' || doc_id ELSE rel END AS rel, CASE doc_id % 10 WHEN 0 THEN text || '.' ELSE text END AS text FROM one WHERE doc_id % 10 <> 1),
    d1 AS (SELECT *, sha256(text) AS sha, strlen(text) AS size FROM one), d2 AS (SELECT *, sha256(text) AS sha, strlen(text) AS size FROM two),
    s1 AS (SELECT size FROM d1 WHERE size > 0 GROUP BY size HAVING count(*) > 1), h1 AS (SELECT size, sha256(encode(text)[1:64]) AS p, doc_id FROM d1 JOIN s1 USING (size)),
    k1 AS (SELECT doc_id FROM h1 JOIN (SELECT size, p FROM h1 GROUP BY ALL HAVING count(*) > 1) USING (size, p)),
    s2 AS (SELECT size FROM d2 WHERE size > 0 GROUP BY size HAVING count(*) > 1), h2 AS (SELECT size, sha256(encode(text)[1:64]) AS p, doc_id FROM d2 JOIN s2 USING (size)),
    k2 AS (SELECT doc_id FROM h2 JOIN (SELECT size, p FROM h2 GROUP BY ALL HAVING count(*) > 1) USING (size, p)),
    known AS (SELECT doc_id FROM k1 WHERE doc_id % 10 <> 0),
    c AS (SELECT doc_id, rel, CASE doc_id % 10 WHEN 0 THEN 'changed' WHEN 2 THEN 'moved' ELSE 'same' END AS change,
      CASE WHEN size = 0 THEN 'empty' WHEN doc_id IN (FROM known) AND size IN (FROM s2) THEN 'cache' WHEN doc_id IN (FROM k2) THEN 'read' END AS source, sha FROM d2)
    SELECT rel, change, source, CASE WHEN source IS NOT NULL THEN sha END AS sha256 FROM c
    UNION ALL SELECT rel, 'gone', NULL, NULL FROM one WHERE doc_id % 10 IN (1, 2)"""
)
def inventory_rescan(spark, sf_dir):
    """Two walks and deep scans of a tree of documents, of which a tenth each changed, went and moved between them."""
    d = views.table(spark, sf_dir, "documents")
    k, number = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    rel = F.concat_ws("/", (F.col("doc_id") % 7).cast("string"), number)
    base = _new_tree(spark)
    roots = spark.createDataFrame([(base,)], "root string")
    write_files(d.select(rel.alias("rel"), F.col("text").alias("content")), base)
    kept = inventory.Inventory(spark, f"{base}-inventory")
    first = kept.record(walk.walk(roots))
    kept.scan(prefix_bytes=64)
    write_files(d.filter(k == 0).select(rel.alias("rel"), F.concat("text", F.lit(".")).alias("content")), base)
    delete_files(d.filter(k == 1).select(rel.alias("rel")), base)
    _move(d.filter(k == 2).select(rel.alias("rel"), F.concat(F.lit("moved/"), number).alias("to")), base)
    second = kept.record(walk.walk(roots))
    last = kept.scan(prefix_bytes=64)
    found = inventory.changes(kept.read(first).select(*kept.read(first).columns[:6]), kept.read(second).select(*kept.read(second).columns[:6]))
    return found.join(kept.read(last).select("root", "rel", "source", "sha256"), ["root", "rel"], "left").select("rel", "change", "source", "sha256")


def _move(rows: DataFrame, base: str) -> None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = resolve(base)
        for batch in batches:
            for rel, to in zip(batch["rel"], batch["to"]):
                if system.get_file_info(f"{top}/{rel}").is_file:  # else an earlier attempt has moved it
                    system.create_dir(os.path.dirname(f"{top}/{to}"), recursive=True)
                    system.move(f"{top}/{rel}", f"{top}/{to}")
            yield batch[["rel"]]

    rows.select("rel", "to").mapInPandas(run, "rel string").write.format("noop").mode("overwrite").save()
