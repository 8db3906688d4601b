"""Summary cards over per-entity totals: top, worst, mean and the reports'
own "median".

The house median of sorted values a[0..n-1] (0-based) is
    n odd  -> (a[floor(n/2)] + a[ceil(n/2)]) / 2   (the middle and the one above)
    n even -> a[n/2]                               (the upper middle)
and, for the coupon report, no value at all when n = 2.

Input is one row per entity (a coupon's or a category's total), already
aggregated.  There can be many entities (every coupon code ever used), so
they are not ranked: the median is selected.  A quantile sketch brackets the
two ranks it needs, one row in some 1,600 lies inside, all below count as one
group, and the ranks are read off the counts of the values inside.  It is one
lazy plan, in which the entities' aggregation is an exchange that is reused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table


def global_rank(df: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """``df`` with ``_rn`` (1-based rank in ``order``, which must be unique)
    and ``_n`` (row count), without a single-partition window.

    Rows are range-partitioned on ``order`` and sorted; each range partition numbers
    its rows as it writes them, and the ranks of the earlier partitions are added from
    the partition sizes (one row per partition, so that small window is bounded
    by ``partitions``, not by the data).  The rows move once.
    """
    # written once and read for both branches: planned twice, the ranges would be
    # sampled twice, and the offsets would belong to other partitions
    ranged = write_table(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumns(
        {"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    # the lower 33 bits are the row's place in its partition
    local = ranged.withColumn("_lrn", F.col("_at") % (1 << 33) + 1)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn("_rn", F.col("_off") + F.col("_lrn"))
            .drop("_pid", "_at", "_lrn", "_off"))


#: Accuracy of the quantile sketch, and the number of entities up to which the
#: bracket is everything.  Beyond it, the sketch's rank error is 1e-4 of the
#: entities and the ranks lie within 2e-4 of the middle.
ACCURACY = 10_000
BRACKET = (0.4998, 0.5004)


def selected_median(t: DataFrame, null_when_two: bool) -> Column:
    """The house median of column ``_v`` of ``t``, as a scalar subquery."""
    x = F.coalesce(F.col("_v").cast("double"), F.lit(float("-inf")))  # nulls come first
    n = F.count(F.lit(1))
    few = n <= ACCURACY
    q = F.percentile_approx(x, F.array(*[F.lit(p) for p in BRACKET]), ACCURACY)
    bounds = t.agg(F.struct(
        n.alias("n"), F.when(few, F.lit(float("-inf"))).otherwise(q[0]).alias("lo"),
        F.when(few, F.lit(float("inf"))).otherwise(q[1]).alias("hi")).alias("b")).scalar()
    near = t.select(F.when(x >= bounds["lo"], F.col("_v")).alias("_v"), x.alias("_x")).filter(F.col("_x") <= bounds["hi"])
    counts = near.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(F.col("_v").cast("double").alias("_v"), upto.alias("_to"), (upto - F.col("_c")).alias("_from"),
                           bounds["n"].alias("_n"))
    at = lambda r: F.max(F.when((F.col("_from") < r) & (F.col("_to") >= r), F.col("_v")))
    middle = F.floor(F.col("_n") / 2) + 1
    count = F.max("_n")
    median = F.when(count % 2 == 1, (at(middle) + F.coalesce(at(middle + 1), F.lit(0.0))) / 2.0).otherwise(at(middle))
    if null_when_two:
        median = F.when(count != 2, median)
    return ranked.agg(median.alias("m")).scalar()


def entity_stats(totals: DataFrame, name: str, value: str, tie: Column,
                 null_median_when_two: bool) -> DataFrame:
    """One row: n, top, top_total, worst, worst_total, average, median.

    ``tie`` orders entities with equal totals: the first (smallest tie key)
    wins both top and worst, as a first-seen scan over the input order would.
    Top, worst, count and sum are plain global aggregates (partial
    aggregation per task).
    """
    t = totals.select(F.col(name).alias("_name"), F.col(value).alias("_v"), tie.alias("_tie"))
    n = F.count(F.lit(1))
    return t.agg(
        n.cast("bigint").alias("n"),
        F.min_by("_name", F.struct(-F.col("_v"), F.col("_tie"))).alias("top"),
        F.max("_v").cast("double").alias("top_total"),
        F.min_by("_name", F.struct(F.col("_v"), F.col("_tie"))).alias("worst"),
        F.min("_v").cast("double").alias("worst_total"),
        F.try_divide(F.sum("_v").cast("double"), n.cast("double")).alias("average"),
    ).withColumn("median", selected_median(t.select("_v"), null_median_when_two))
