"""Report 2: daily sales over a day range, with a gap-filled calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.dates import after_start_before_end_day
from ..functions.numbers import MONEY, absint, ratio, round2_ratio
from ..model import DEFAULT, Params, Shop
from ..operators.calendar import gap_fill, report_day_spine
from .common import completed_orders, date_hint, items_of


def orders_in_range(shop: Shop, params: Params, hooks=None, others=()) -> DataFrame:
    o = completed_orders(shop).filter(after_start_before_end_day(F.col("created"), params.start, params.end)
                                      & F.col("total").isNotNull())
    if shop.fanout:
        # the original groups this statement by order id: one row per order
        o = o.dropDuplicates(["order_id"])
    return H.apply(hooks, "daily.orders", o.select("order_id", "created", "total", *others),
                   start=params.start, end=params.end)


def daily_sales(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(day date, orders bigint, amount double) per day, in day order.

    The calendar is [start, end) (one day when start = end); a day outside it
    appears only when it has orders — that is how the end day shows up.
    """
    o = orders_in_range(shop, params, hooks)
    per_day = o.groupBy(F.to_date("created").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total").alias("amount"))
    spine = report_day_spine(shop.orders.sparkSession, params.start, params.end)
    out = gap_fill(spine, per_day, ["day"],
                   {"orders": F.lit(0).cast("bigint"), "amount": F.lit(0).cast(MONEY)}, how="full")
    return out.select("day", F.col("orders").cast("bigint"), F.col("amount").cast("double")).orderBy("day")


def daily_sales_summary(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """One row: total_sales, total_orders, total_items, average_total, average_items.

    Items are abs(int()) of each order's quantity sum, then added up.  The
    stored model's orders carry that sum.  Otherwise line quantities are summed
    per order before the join (map-side combine), so one order with a huge
    number of lines is one row by the time it meets the orders — the preserved
    side of a left join, which AQE could not split for it.
    """
    carried = "line_qty" in shop.orders.columns and not (hooks and "daily.orders" in hooks)
    o = orders_in_range(shop, params, hooks, ["line_qty"] if carried else [])
    if carried:
        per_order = o.select("order_id", "total", F.col("line_qty").alias("qty"))
    else:
        in_range = lambda c: after_start_before_end_day(c, params.start, params.end)
        qty = (date_hint(items_of(shop, "line_item"), in_range)
               .groupBy("order_id").agg(F.sum("qty").alias("qty")))
        per_order = o.join(qty, "order_id", "left").select("order_id", "total", "qty")
    per_order = H.apply(hooks, "daily.order_items", per_order, start=params.start, end=params.end)
    agg = per_order.agg(F.sum("total").alias("s"), F.count(F.lit(1)).alias("n"),
                        F.sum(absint("qty")).alias("q"))
    n, items = F.col("n"), F.coalesce(F.col("q"), F.lit(0)).cast("bigint")
    sales = F.coalesce(F.col("s"), F.lit(0))
    return agg.select(
        sales.cast("double").alias("total_sales"), n.cast("bigint").alias("total_orders"),
        items.alias("total_items"), ratio(sales, n).alias("average_total"),
        F.when(n > 0, round2_ratio(items, n)).otherwise(F.lit(0.0)).alias("average_items"))
