"""Running numbers over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import sized, written

#: Low bits of monotonically_increasing_id: the row within its partition.
_ROW_BITS = 33


def numbered(frame: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``frame`` with ``name``: 1, 2, 3... in each ``group`` in the order of ``order`` (ascending, nulls first).

    Rows are sorted over ranges of (group, order) and written once with the range and the place they got;
    counts and rows then come from the same files, so both agree whatever boundaries the sampling chose.  A
    crowded group spreads over many ranges; only rows equal in all of ``group`` and ``order`` share one, in an
    order that is fixed by the written table but otherwise free.  An empty frame gives no rows; columns named
    ``_at``, ``_base`` or ``_first`` are not allowed in ``frame``.
    """
    at = F.monotonically_increasing_id()
    ranged = written(frame.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", at), "numbered")
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    keys = [F.col(c) for c in group]
    counts = ranged.groupBy(*keys, part.alias("_range")).agg(F.count("*").alias("_rows"), F.min(row).alias("_first"))
    # a row for each group and each range it touches: at most groups + ranges of them
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(
        *[F.col(c).alias(f"_g{n}") for n, c in enumerate(group)], "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"),
    )
    same = part == F.col("_range")
    for n, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{n}"))
    joined = ranged.join(sized(bases), same)
    return joined.select(*frame.columns, (F.col("_base") + row).alias(name))
