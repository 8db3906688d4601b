"""Date helpers: half-open ranges (so parquet min/max pruning applies),
month keys and epoch-millisecond chart labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: dt.datetime | dt.date) -> Column:
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def date_lit(value: dt.date) -> Column:
    return F.lit(value.strftime("%Y-%m-%d")).cast("date")


def after_start_before_end_day(ts: Column, start: dt.date, end: dt.date) -> Column:
    """The reports' open day range: ts > start 00:00:00 and ts < end + 1 day."""
    return (ts > ts_lit(start)) & (ts < ts_lit(end + dt.timedelta(days=1)))


def in_year(ts: Column, year: int) -> Column:
    return (ts >= ts_lit(dt.date(year, 1, 1))) & (ts < ts_lit(dt.date(year + 1, 1, 1)))


def month_of(ts: Column) -> Column:
    return F.month(ts).cast("int")


def yyyymm(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def epoch_millis(day: Column) -> Column:
    """Chart x value: midnight of the day in epoch milliseconds (UTC)."""
    return F.unix_millis(F.to_timestamp(day))


def months_started_by(year: int, now: dt.datetime) -> int:
    """Months of ``year`` whose first day is not after ``now`` (0..12)."""
    count = 0
    for m in range(1, 13):
        if dt.datetime(year, m, 1) <= now:
            count += 1
    return count


def matrix_months(year: int, now: dt.datetime) -> int:
    """Columns of the coupon and category matrices: the months up to the
    current one when ``year`` is the current year, else all twelve."""
    return now.month if year == now.year else 12


def month_label(ts: Column, full: bool = False) -> Column:
    """Month name for chart and table labels: ``Mar`` or ``March``."""
    return F.date_format(ts, "MMMM" if full else "MMM")


def day_text(ts: Column) -> Column:
    """``yyyy-MM-dd`` text of a day."""
    return F.date_format(ts, "yyyy-MM-dd")
