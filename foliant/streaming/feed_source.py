"""Paged feeds as a streaming source: the offset of a feed is the cursor of the page that comes next.

Pages lie in a store, a folder of Parquet files partitioned by a bucket of the feed's name, with the columns feed, cursor
('' for the first page), next ('' for none), payload.  The driver only follows links, a bucket at a time; executors read the
pages of a bucket.
Every read is tried again after growing waits, as a feed's server would be.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.tables import shared_dir
from ..sources.storage import resolve

SCHEMA = "feed string, number int, cursor string, next string, payload string"
#: Attempts of one read, and the longest wait between two.
ATTEMPTS, LONGEST_WAIT = 3, 120.0
#: Pages of one feed that are ever read.
PAGES = 40
#: Folders of a store, and tasks of a batch.
BUCKETS = 64


def retried(call: Callable, attempts: int = ATTEMPTS, first_wait: float = 1.0):
    """``call()``, again after 1, 2, 4... times ``first_wait`` seconds if the store fails; the last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n == attempts - 1:
                raise
            time.sleep(min(LONGEST_WAIT, first_wait * 2**n))


class PageStore:
    """The pages of feeds in a folder that driver and executors share; feeds lie together by bucket."""

    def __init__(self, path: str):
        self.path = path

    def _rows(self, bucket: int, columns: list[str], only: list[str] | None = None) -> Iterator[dict]:
        """Rows of a bucket, the pages of ``only`` these cursors; a batch of them at a time is in memory."""
        system, name = resolve(self.path)
        folder = f"{name.rstrip('/')}/bucket={bucket}"
        if system.get_file_info(folder).type == pa.fs.FileType.NotFound:
            return
        pages = ds.dataset(folder, filesystem=system, format="parquet")
        for batch in pages.to_batches(columns=columns, filter=None if only is None else ds.field("cursor").isin(only), batch_size=4096):
            yield from batch.to_pylist()

    def links(self, bucket: int) -> dict[str, dict[str, str]]:
        """For each feed of a bucket the cursor after every page, '' at the end; the first of pages with one cursor counts."""
        found: dict[str, dict[str, str]] = {}
        for row in self._rows(bucket, ["feed", "cursor", "next"]):
            found.setdefault(row["feed"], {}).setdefault(row["cursor"], row["next"] or "")
        return found

    def pages(self, bucket: int, wanted: set[tuple[str, str]]) -> list[dict]:
        """The pages (feed, cursor) of a bucket, each once."""
        left, out = set(wanted), []
        for row in self._rows(bucket, ["feed", "cursor", "next", "payload"], sorted({cursor for _, cursor in wanted})):
            if (row["feed"], row["cursor"]) in left:
                left.discard((row["feed"], row["cursor"]))
                out.append(row)
        if left:
            raise KeyError(f"pages are gone: {sorted(left)[:5]}")
        return out


def bucket_of(feed: str) -> int:
    return zlib.crc32(feed.encode()) % BUCKETS


@dataclass
class Pages(InputPartition):
    """Pages to read of one bucket: feed, cursors, number of the first."""

    bucket: int
    feeds: list[tuple[str, list[str], int]]


class FeedReader(DataSourceStreamReader):
    """Offsets are {feed: [cursor of the next page or None at the end, cursors read]}.

    The cursors read stand in the offset (at most ``most`` short strings for each feed), so that a batch can be read
    again from its two offsets and a circle of links ends.  A new reader is not told where the last one stopped, so
    every offset is noted in the file ``position`` before it is handed out: what is noted is never behind the checkpoint.
    """

    def __init__(self, store: PageStore, per_batch: int, most: int, wait: float, position: str):
        self.store, self.per_batch, self.most, self.wait, self.position = store, per_batch, most, wait, position
        self.now: dict | None = None

    def _noted(self) -> dict | None:
        system, name = resolve(self.position)
        if system.get_file_info(name).type == pa.fs.FileType.NotFound:
            return None
        with system.open_input_stream(name) as file:
            return json.loads(file.read())

    def _note(self) -> None:
        system, name = resolve(self.position)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{name}.new") as file:
            file.write(json.dumps(self.now).encode())
        system.move(f"{name}.new", name)

    def initialOffset(self) -> dict:
        return {feed: ["", []] for bucket in range(BUCKETS) for feed in retried(lambda: self.store.links(bucket), first_wait=self.wait)}

    def _step(self, links: dict[str, str], cursor: str | None, seen: list[str]) -> list:
        seen = list(seen)
        for _ in range(self.per_batch):
            if cursor is None or len(seen) >= self.most:
                break
            after = links.get(cursor)
            if after is None:  # not there yet: asked for again with the next batch
                break
            seen.append(cursor)
            cursor = after if after and after not in seen else None
        return [cursor, seen]

    def latestOffset(self) -> dict:
        """One reading of each bucket's links moves all of its feeds on."""
        at = dict(self.now or (self.position and self._noted()) or {})
        for bucket in range(BUCKETS):
            for feed, links in retried(lambda: self.store.links(bucket), first_wait=self.wait).items():
                at[feed] = self._step(links, *at.get(feed, ["", []]))
        self.now = at
        if self.position:
            self._note()
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        out: dict[int, list] = {}
        for feed, (_, seen) in end.items():
            before = len(start.get(feed, ["", []])[1])
            if len(seen) > before:
                out.setdefault(bucket_of(feed), []).append((feed, seen[before:], before))
        return [Pages(bucket, feeds) for bucket, feeds in sorted(out.items())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        numbers = {(feed, cursor): first + n for feed, cursors, first in partition.feeds for n, cursor in enumerate(cursors)}
        for page in retried(lambda: self.store.pages(partition.bucket, set(numbers)), first_wait=self.wait):
            yield page["feed"], numbers[page["feed"], page["cursor"]], page["cursor"], page["next"], page["payload"]

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FeedSource(DataSource):
    """``spark.readStream.format("feed_pages").option("path", store)``; options pages_per_batch, max_pages, first_wait,
    and position, a shared file that a stream which is started again needs."""

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return SCHEMA

    def store(self) -> PageStore:
        return PageStore(self.options["path"])

    def streamReader(self, schema) -> FeedReader:
        number = lambda key, default: type(default)(self.options.get(key, default))
        return FeedReader(self.store(), number("pages_per_batch", 10), number("max_pages", PAGES), number("first_wait", 1.0), self.options.get("position", ""))


def feed_stream(spark: SparkSession, path: str, source: type[FeedSource] = FeedSource, **options) -> DataFrame:
    """feed, number (from 0), cursor, next, payload of the pages that the feeds under ``path`` reach."""
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def save_pages(pages: DataFrame, path: str) -> None:
    """Write pages (feed, cursor, next, payload) as a store; null cursors and links are '', a feed without a name has the writer's name for none."""
    named = pages.selectExpr("coalesce(nullif(feed, ''), '__HIVE_DEFAULT_PARTITION__') AS feed", "coalesce(cursor, '') AS cursor", "coalesce(next, '') AS next", "payload")
    named.withColumn("bucket", F.crc32(F.col("feed").cast("binary")) % BUCKETS).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_feed(spark: SparkSession, path: str, *, source: type[FeedSource] = FeedSource, at: str | None = None, **options) -> DataFrame:
    """All pages that can be reached now, as a table; with ``at`` (of an earlier call) only those that came since are read.

    The file sink writes each batch once; runs from the same ``at`` go on where the last one ended.
    """
    at = at or f"{shared_dir(spark)}/feed-{time.time_ns()}"
    query = feed_stream(spark, path, source, position=f"{at}/position.json", **options).writeStream.format("parquet").option("checkpointLocation", f"{at}/log").start(f"{at}/out")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(SCHEMA).parquet(f"{at}/out")
