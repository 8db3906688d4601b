"""Top-k, bounded lookups and rank numbers.

``top_k`` is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: every task keeps its own k best rows and only those
k x tasks rows meet in one place.  Ranks and bar maxima are computed after
the limit, so the single-partition window they need holds at most k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    best = df.orderBy(*order).limit(k)
    # k rows only: this window's single partition is bounded by k
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("int"))


def lookup_bounded(keys: DataFrame, dim: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Left-join dimension columns onto a frame of at most a few rows (a top-k;
    missing dimension rows give nulls).

    Broadcast (their number is the caller's k), the keys pick their rows out of
    the dimension's scan, which is read once and not shuffled; those rows, one a
    key (``dim`` is unique on it), are broadcast back.  The keys stand in the plan
    twice; their exchange is reused, so what found them runs once."""
    wanted = dim.select(on, *cols).join(F.broadcast(keys.select(on)), on, "left_semi")
    return keys.join(F.broadcast(wanted), on, "left")
