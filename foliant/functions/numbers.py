"""Small column arithmetic: markers, slack, retries, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def marker_index(marker: Column) -> Column:
    """a is 0, a number is itself, anything else -1."""
    return F.when(marker.rlike("^[a-zA-Z]$"), F.ascii(F.lower(marker)) - 97).otherwise(F.coalesce(marker.try_cast("int"), F.lit(-1)))


def refine_slop(width: Column, height: Column) -> Column:
    """Pixels of slack of a refined search: what one pixel of a 320-pixel overview stands for, and two; at least 8."""
    return F.greatest(F.lit(8), (F.ceil(F.greatest(width, height) / 320.0) + 2).cast("int"))


def backoff(attempt: Column, retry_after: Column, most: float = 120.0) -> Column:
    """Seconds before another attempt: doubling from one, or what the server asks for, up to ``most``."""
    asked = F.when(retry_after >= 0, retry_after)
    return F.least(F.lit(most), F.coalesce(asked.cast("double"), F.pow(F.lit(2.0), attempt - 1)))


def finite(value: Column) -> Column:
    """Zero for what is no finite number."""
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), 0.0).otherwise(value)


def retry_after(header: Column) -> Column:
    """Whole seconds of a Retry-After header; null for dates and anything else."""
    return F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).try_cast("int"))


def megabytes(size: Column) -> Column:
    return F.bround(size / 2.0**20, 3)


def megapixels(pixels: Column) -> Column:
    return F.bround(pixels / 1e6, 3)


def area_percent(part: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 without a total."""
    return F.when(total > 0, F.bround(100.0 * part / total).cast("int")).otherwise(0)
