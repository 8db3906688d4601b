"""Report 1: all-time totals (sales, orders, items, discounts, shipping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.numbers import MONEY, absint, ratio, round2_ratio
from ..model import Shop
from .common import completed, completed_orders, items_of_orders, tagged_union


def totals_overview(shop: Shop, hooks: H.Hooks | None = None) -> DataFrame:
    """One row: total_sales, total_orders, total_items, average_total,
    average_items, discounts, shippings.

    Orders without a total are not counted (the statement joins the key).
    Orders and shipping/discounts count completed ``shop_order`` posts; the
    item count takes line items of every completed post (refunds included)
    and applies abs(int()) once to the grand sum.  Four independent totals
    become one global aggregation over a tagged union: one scan per table,
    partial aggregation per task, a single tiny final merge.
    """
    orders = completed_orders(shop)
    sales = H.apply(hooks, "totals.orders", orders)
    discounts = H.apply(hooks, "totals.discounts", orders)
    shipping = H.apply(hooks, "totals.shipping", orders)
    items = items_of_orders(shop, "line_item", completed(), ["order_id", "qty"]).select("qty")
    items = H.apply(hooks, "totals.items", items)

    disc = (F.coalesce("order_discount", F.lit(0)) + F.coalesce("cart_discount", F.lit(0))).alias("disc")
    if sales is discounts and sales is shipping:
        # no hook split them: read the orders once
        frames = {1: sales.select("total", "shipping", disc), 4: items}
    else:
        frames = {1: sales.select("total"), 2: discounts.select(disc),
                  3: shipping.select("shipping"), 4: items}
    u = tagged_union(frames, {"total": MONEY, "disc": "decimal(20,4)", "shipping": MONEY, "qty": MONEY})
    one = (F.col("src") == 1)
    agg = u.agg(
        F.sum(F.when(one, F.col("total"))).alias("s"),
        F.count(F.when(one, F.col("total"))).alias("n"),
        F.sum(F.when(F.col("src").isin(1, 2), F.col("disc"))).alias("d"),
        F.sum(F.when(F.col("src").isin(1, 3), F.col("shipping"))).alias("sh"),
        F.sum(F.when(F.col("src") == 4, F.col("qty"))).alias("q"),
    )
    n = F.col("n")
    items_total = absint("q")
    return agg.select(
        F.coalesce(F.col("s"), F.lit(0)).cast("double").alias("total_sales"),
        n.cast("bigint").alias("total_orders"),
        items_total.alias("total_items"),
        ratio(F.coalesce(F.col("s"), F.lit(0)), n).alias("average_total"),
        F.when(n > 0, round2_ratio(items_total, n)).otherwise(F.lit(0.0)).alias("average_items"),
        F.coalesce(F.col("d"), F.lit(0)).cast("double").alias("discounts"),
        F.coalesce(F.col("sh"), F.lit(0)).cast("double").alias("shippings"),
    )


TOTALS_ORDER = ("total_sales", "total_orders", "total_items", "average_total",
                "average_items", "discounts", "shippings")


def report_rows(report: DataFrame, metrics=TOTALS_ORDER) -> DataFrame:
    """Key/value form of a one-row report: (ord, metric, value double)."""
    pairs = ", ".join(f"{i + 1}, '{m}', CAST({m} AS DOUBLE)" for i, m in enumerate(metrics))
    return report.selectExpr(f"stack({len(metrics)}, {pairs}) AS (ord, metric, value)").select(
        F.col("ord").cast("int").alias("ord"), "metric", "value")
