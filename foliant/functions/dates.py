"""Column functions over instants and local windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """ISO time, UTC without an offset; null for anything else."""
    return F.try_to_timestamp(text)


def local_day(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def in_window(at: Column, zone: str, since: str | None, until: str | None) -> Column:
    """in, out or missing: ``since`` is inclusive, ``until`` exclusive, both local midnights."""
    local = F.from_utc_timestamp(at, zone)
    fits = F.lit(True)
    if since:
        fits = fits & (local >= F.lit(since).cast("timestamp"))
    if until:
        fits = fits & (local < F.lit(until).cast("timestamp"))
    return F.when(at.isNull(), "missing").when(fits, "in").otherwise("out")


def months_back(day: Column, months: int) -> Column:
    """The same day months earlier, the month's last if there is none."""
    return F.add_months(day, -months)


def older_than(at: Column, now: Column, days: int) -> Column:
    """Whether at least ``days`` whole days lie between; exactly so many count."""
    return now >= at + F.expr(f"INTERVAL {days} DAYS")


def window_start(now: Column, zone: str, since: Column, last_months: Column) -> Column:
    """Local midnight from which posts count: the day given, else as many months before today; null for all."""
    today = F.to_date(F.from_utc_timestamp(now, zone))
    return F.coalesce(since.try_cast("date"), F.when(last_months > 0, F.add_months(today, -last_months))).cast("timestamp")


def window_end(now: Column, zone: str, until: Column) -> Column:
    """Local midnight before which posts count: the day given, else tomorrow."""
    return F.coalesce(until.try_cast("date"), F.date_add(F.to_date(F.from_utc_timestamp(now, zone)), 1)).cast("timestamp")
