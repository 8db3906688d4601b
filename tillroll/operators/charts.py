"""Chart series: one JSON text ``[[x_ms,value],...]`` per series.

The reports' charts plot one point per calendar step (a day of the range, a
month of the year) for each entity, so a series holds at most as many
points as the report calendar; ``collect_list`` per series is bounded by
that, never by the number of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chart_series(points: DataFrame, series: list[str], x_ms: Column, value: Column) -> DataFrame:
    """(series..., points) with points ordered by ``x_ms``; ``value`` is
    rendered as text (cast numbers to a fixed-scale decimal first when the
    text must be stable)."""
    pts = points.select(*series, F.struct(x_ms.cast("bigint").alias("x"), value.cast("string").alias("v")).alias("p"))
    grouped = pts.groupBy(*series).agg(F.array_sort(F.collect_list("p")).alias("pts"))
    text = F.array_join(F.transform("pts", lambda p: F.concat(
        F.lit("["), p["x"].cast("string"), F.lit(","), p["v"], F.lit("]"))), ",")
    return grouped.select(*series, F.concat(F.lit("["), text, F.lit("]")).alias("points"))
