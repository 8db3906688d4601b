"""Calendar spines and gap filling.

A spine is generated by ``sequence`` + ``explode`` on one row, so it costs no
scan; its size is bounded by the report range (days of a range, months of a
year), never by the data.  Gap filling is an outer join of the spine with an
already aggregated frame (one row per day or month), so both sides are small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_lit


def day_spine(spark: SparkSession, start: dt.date, count: int, name: str = "day") -> DataFrame:
    """``count`` consecutive days from ``start`` (empty when count <= 0)."""
    if count <= 0:
        return spark.range(0).select(F.lit(None).cast("date").alias(name))
    last = start + dt.timedelta(days=count - 1)
    return spark.range(1).select(
        F.explode(F.sequence(date_lit(start), date_lit(last), F.expr("INTERVAL 1 DAY"))).alias(name))


def report_day_spine(spark: SparkSession, start: dt.date, end: dt.date, name: str = "day") -> DataFrame:
    """The daily report's pre-seeded days: [start, end), one day when start = end."""
    days = (end - start).days
    if days == 0:
        days = 1
    return day_spine(spark, start, days, name)


def int_spine(spark: SparkSession, first: int, last: int, name: str) -> DataFrame:
    if last < first:
        return spark.range(0).select(F.lit(None).cast("int").alias(name))
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last)).cast("array<int>")).alias(name))


def month_spine(spark: SparkSession, year: int, months: int) -> DataFrame:
    """(month int, month_start date) for the first ``months`` months of ``year``."""
    return int_spine(spark, 1, months, "month").select(
        "month", F.make_date(F.lit(year), F.col("month"), F.lit(1)).alias("month_start"))


def gap_fill(spine: DataFrame, facts: DataFrame, keys: list[str], zeros: dict[str, Column],
             how: str = "left", on: list[str] | None = None) -> DataFrame:
    """Join ``facts`` onto ``spine`` and replace missing measures.

    ``how="full"`` also keeps fact keys outside the spine (the daily report's
    end day).  ``zeros`` maps a measure column to its fill value; ``keys`` are
    the output key columns, ``on`` the join keys (default: ``keys``).
    """
    joined = spine.join(facts, on or keys, how)
    return joined.select(*keys, *[F.coalesce(F.col(c), z).alias(c) for c, z in zeros.items()])
