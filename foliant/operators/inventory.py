"""The inventory between runs: what a walk found, what changed since the last one, and digests that stay known."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import resolve
from .dedupe import EMPTY_SHA256, PREFIX_BYTES, colliding
from .tables import written

#: What makes a file the same between runs: content is read again when any of it changes.
KEY = ("dev", "inode", "size", "mtime")
FILES = "root string, rel string, size bigint, mtime double, dev bigint, inode bigint"
CACHE = "dev bigint, inode bigint, size bigint, mtime double, place string, prefix string, sha256 string"
_CHUNK = 1 << 20


def place() -> Column:
    """Where there are no inode numbers the path takes their place; else it is empty, so that a renamed file stays known."""
    return F.when(F.coalesce("inode", F.lit(0)) == 0, F.concat_ws("/", "root", "rel")).otherwise("")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """root, rel, change of two walks: added, changed, same, moved (known by its key under another path) or gone."""
    b = before.select("root", "rel", *[F.col(k).alias(f"_{k}") for k in KEY], F.lit(True).alias("_was"))
    both = after.withColumn("_is", F.lit(True)).join(b, ["root", "rel"], "full_outer")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    kept = both.withColumn("change", F.when(F.col("_is").isNull(), "gone").when(F.col("_was").isNull(), "added").when(same, "same").otherwise("changed"))
    paths = before.filter(F.coalesce("inode", F.lit(0)) != 0).select(*KEY).distinct().withColumn("_known", F.lit(True))
    found = kept.join(paths, list(KEY), "left")
    return found.select("root", "rel", F.when((F.col("change") == "added") & F.col("_known"), "moved").otherwise(F.col("change")).alias("change"))


def _digests(rows: DataFrame, most: int | None) -> DataFrame:
    """n, digest, error of the files (n, address): the SHA-256 of the first ``most`` bytes, or of all, in chunks."""

    def one(address: str) -> str:
        system, name = resolve(address)
        state, left = hashlib.sha256(), most
        with system.open_input_stream(name) as file:
            while chunk := file.read(_CHUNK if left is None else min(_CHUNK, left)):
                state.update(chunk)
                left = None if left is None else left - len(chunk)
        return state.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, address in zip(batch["n"], batch["address"]):
                try:
                    out.append((n, one(address), None))
                except OSError as problem:
                    out.append((n, None, f"{type(problem).__name__}: {problem.strerror or problem}"))
            yield pd.DataFrame(out, columns=["n", "digest", "error"], dtype=object).astype({"n": "int64"})

    return rows.mapInPandas(run, "n bigint, digest string, error string")


def _read(rows: DataFrame, most: int | None, kind: str) -> DataFrame:
    """KEY, place, digest, error of each distinct file among ``rows``, read once however many names it has."""
    keys = [*KEY, "place"]
    once = rows.groupBy(*keys).agg(F.min(F.concat_ws("/", "root", "rel")).alias("address"))
    # dealt anew, since what is left to read may lie in few partitions; written, so that no byte is read twice
    spread = written(once.repartition(once.sparkSession.sparkContext.defaultParallelism * 2).withColumn("n", F.monotonically_increasing_id()), f"{kind}-todo")
    read = written(_digests(spread.select("n", "address"), most), kind)
    return spread.join(read, "n").select(*keys, "digest", "error")


def _equal(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by KEY and place, whose parts may be null."""
    keys = [*KEY, "place"]
    other = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def deep_scan(files: DataFrame, cache: DataFrame, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """root, rel, KEY, place, prefix, sha256, source, error of the files (FILES) of the last walk; nothing is walked again.

    Only files whose size occurs twice are looked at; those of them that ``cache`` (CACHE) knows are not read; of the
    others prefixes are read, and whole files only where size and prefix collide.  source: empty, cache, read, or null
    (no digest was needed or, with an error, possible).  Names of one file (hard links) cost one read.
    """
    rows = files.select(*[c.split()[0] for c in FILES.split(", ")]).withColumn("place", place())
    empty, rest = rows.filter("size = 0"), rows.filter("size > 0")
    crowd = written(_equal(colliding(rest, "size"), cache.filter("sha256 IS NOT NULL").dropDuplicates([*KEY, "place"]), "left"), "crowd")
    prefixes = _read(crowd.filter("sha256 IS NULL"), prefix_bytes, "prefixes").select(*KEY, "place", F.col("digest").alias("_prefix"), "error")
    seen = written(_equal(crowd, prefixes, "left").withColumn("prefix", F.coalesce("prefix", "_prefix")).drop("_prefix"), "seen")
    still = colliding(seen.filter("prefix IS NOT NULL"), "size", "prefix")
    whole = _read(still.filter("sha256 IS NULL"), None, "digests").select(*KEY, "place", F.col("digest").alias("_whole"), F.col("error").alias("_error"))
    hashed = _equal(seen, whole, "left").select(
        "root", "rel", *KEY, "place", "prefix", F.coalesce("sha256", "_whole").alias("sha256"),
        F.when(F.col("sha256").isNotNull(), "cache").when(F.col("_whole").isNotNull(), "read").alias("source"), F.coalesce("error", "_error").alias("error"),
    )
    none = F.lit(None).cast("string")
    plain = lambda frame, digest, source: frame.select("root", "rel", *KEY, "place", digest.alias("prefix"), digest.alias("sha256"), source.alias("source"), none.alias("error"))
    alone = rest.join(seen.select("size").distinct(), "size", "left_anti")
    return hashed.unionByName(plain(empty, F.lit(EMPTY_SHA256), F.lit("empty"))).unionByName(plain(alone, none, none)).unionByName(plain(rows.filter("size IS NULL"), none, none))


class Inventory:
    """Versions of an inventory in a shared folder: each run adds one, and the newest finished one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = hadoop(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder) if system.exists(hadoop(s.getPath(), "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def read(self, version: int | None = None) -> DataFrame:
        """root, rel, KEY, place, prefix, sha256, source, error of a version (the newest)."""
        found = self.versions()
        schema = f"{FILES}, place string, prefix string, sha256 string, source string, error string"
        if version is None and not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={found[-1] if version is None else version}")

    def _write(self, rows: DataFrame) -> int:
        number = (self.versions() or [-1])[-1] + 1
        # without its marker of success a version does not count: a run that dies leaves the last one the newest
        rows.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        return number

    def record(self, walked: DataFrame) -> int:
        """Add the files of a walk; those known from the version before keep their digests.  The number of the new version."""
        files = walked.filter("kind = 'file'").select(*[c.split()[0] for c in FILES.split(", ")]).withColumn("place", place())
        known = self.cache().select(*KEY, "place", "prefix", "sha256")
        return self._write(_equal(files, known, "left").withColumn("source", F.when(F.col("sha256").isNotNull(), "cache")).withColumn("error", F.lit(None).cast("string")))

    def cache(self) -> DataFrame:
        """CACHE of the newest version: the digests that were ever computed and still belong to a file."""
        columns = [c.split()[0] for c in CACHE.split(", ")]
        return self.read().filter("sha256 IS NOT NULL").select(*columns).dropDuplicates([*KEY, "place"])

    def scan(self, prefix_bytes: int = PREFIX_BYTES) -> int:
        """Deep scan of the newest version, as another version."""
        return self._write(deep_scan(self.read(), self.cache(), prefix_bytes))


def new_inventory(spark: SparkSession, base: str) -> Inventory:
    return Inventory(spark, f"{base}/inventory-{uuid.uuid4().hex}")
