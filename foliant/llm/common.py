"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import tables

#: The C library's call that returns free memory, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A to Z onto a to z; other letters keep their case.
ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_UPPER = "".join(map(chr, ASCII_LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def text_of(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order, without the empty strings that leading or trailing white space leaves."""
    return F.filter(F.split(text, WORD_GAP), lambda word: word != "")


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo a fold count; a null id falls in no fold but the training ones."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(-1))


#: What the modules keep in a Python worker between tasks, by module: how to let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Say that ``module`` keeps things in a worker; tasks of other modules call ``clear`` first."""
    _KEPT[module] = clear


def begin_task(module: str) -> None:
    """A worker serves many tasks: what other operators have kept in it (tokenizers, models) goes."""
    for owner, clear in _KEPT.items():
        if owner != module:
            clear()


def end_task() -> None:
    """Give freed memory back to the system, so that idle workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_arrow(
    frame: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]],
    schema: str,
    slice_bytes: int = 8 << 20,
    closing: bool = False,
) -> DataFrame:
    """Apply ``make()``, built once in each task, to record batches of ``frame``.

    It returns columns (name to list or Arrow array) for each batch. Batches are bounded in rows and
    bytes by spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch, and handed on in slices of
    about ``slice_bytes``, which bounds what a step makes of one.  With ``closing`` a last call gets None.
    """
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(make.__module__)
        step = make()
        cells = lambda c, f: c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
        for part in _slices(batches, slice_bytes, closing):
            for columns in step(part):
                yield pa.RecordBatch.from_arrays([cells(columns[f.name], f) for f in target], schema=target)
        del step
        end_task()

    return frame.mapInArrow(run, fields)


def filter_arrow(frame: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], slice_bytes: int = 8 << 20) -> DataFrame:
    """Apply ``step``, which leaves out rows and keeps all columns by position, to slices of ``frame``; names may repeat."""
    numbered = frame.toDF(*map(str, range(len(frame.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(step.__module__)
        yield from map(step, _slices(batches, slice_bytes, False))
        end_task()

    return numbered.mapInArrow(run, numbered.schema).toDF(*frame.columns)


def _slices(batches: Iterator[pa.RecordBatch], slice_bytes: int, closing: bool) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        rows = max(1, batch.num_rows * slice_bytes // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    if closing:
        yield None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without the setting one beside the warehouse on one machine, an error on a cluster."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables.shared_dir(spark))
    # with its file system in the address, so that executors read it where Spark does
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(frame: DataFrame, kind: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it again: its lineage ends there and a lost executor costs nothing."""
    spark = frame.sparkSession
    path = new_path(spark, kind)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder, whatever its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
