"""Largest running total per group, split so no group is one task.

The product report tracks the highest value a month's running sum reaches
while orders are added in date order.  A window ordered inside each month
would put a hot month into one task.  The maximum prefix sum is
associative over consecutive slices — a slice is summarised by its total S
and its best prefix M, and slice b after slice a gives
max(M_a, S_a + M_b) — so:

1. rows are cut into slices of consecutive rows: by default the range
   partitions of the rows in (group, order) — each is contiguous in that
   order and about 1/partitions of the rows, so even a group holding a
   third of all rows is spread over many tasks;
2. each (group, slice) computes a running sum in its own window partition
   and reduces to (S, M);
3. per group, a window over the slice summaries (at most ``partitions``
   of them) adds the totals of the earlier slices to each M, and the max
   is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import range_partitions


def max_running_sum(df: DataFrame, group: list[str], order: list[str], values: list[str],
                    slice_by: Column | None = None, partitions: int | None = None) -> DataFrame:
    """(group..., <value>_sum, <value>_max_run) per group.

    ``<value>_max_run`` is the largest running total of ``value`` over the
    group's rows in ``order`` (which must be unique within a group).
    ``slice_by`` may name slices instead (they must be contiguous in that
    order, e.g. the hour of a timestamp that leads ``order``).  The empty
    prefix is not counted: callers floor at their own start value.
    """
    if slice_by is None:
        partitions = partitions or range_partitions(df.sparkSession)
        sliced = (df.repartitionByRange(partitions, *group, *order)
                  .withColumn("_slice", F.spark_partition_id()))
    else:
        sliced = df.withColumn("_slice", slice_by)
    w_local = (Window.partitionBy(*group, "_slice").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = sliced.select(*group, "_slice", *values,
                          *[F.sum(v).over(w_local).alias(f"_run_{v}") for v in values])
    per_slice = local.groupBy(*group, "_slice").agg(
        *[F.sum(v).alias(f"_s_{v}") for v in values],
        *[F.max(f"_run_{v}").alias(f"_m_{v}") for v in values])
    w_before = (Window.partitionBy(*group).orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, -1))
    with_offset = per_slice.select(
        *group, *[F.col(f"_s_{v}") for v in values],
        *[(F.coalesce(F.sum(f"_s_{v}").over(w_before), F.lit(0)) + F.col(f"_m_{v}")).alias(f"_c_{v}")
          for v in values])
    return with_offset.groupBy(*group).agg(
        *[F.sum(f"_s_{v}").alias(f"{v}_sum") for v in values],
        *[F.max(f"_c_{v}").alias(f"{v}_max_run") for v in values])
