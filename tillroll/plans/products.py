"""Reports 4-6: top sellers, top earners, monthly history of chosen products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.dates import after_start_before_end_day, yyyymm
from ..functions.numbers import share_of_max
from ..model import DEFAULT, Params, Shop
from ..operators.ranking import lookup_bounded, top_k
from ..operators.running import max_running_sum
from .common import items_of_orders, literal_ids, shop_order

TOP = 25


def _range_lines(shop: Shop, params: Params, point: str, measure: str, hooks) -> DataFrame:
    """Lines in the range that have a product and the measure (the statements
    join both keys, so a line without one of them has no row)."""
    in_range = shop_order() & after_start_before_end_day(F.col("created"), params.start, params.end)
    lines = items_of_orders(shop, "line_item", in_range, ["order_id", "product_id", "qty", "line_total"])
    lines = lines.filter(F.col("product_id").isNotNull() & F.col(measure).isNotNull())
    return H.apply(hooks, point, lines, start=params.start, end=params.end)


def _ranked(per_product: DataFrame, measure: str, shop: Shop) -> DataFrame:
    # ties: product id as text, descending (reverse of a stable ascending sort)
    order = [F.col(measure).desc(), F.col("product_id").cast("string").desc()]
    best = top_k(per_product, TOP, order)
    return lookup_bounded(best, shop.products, "product_id", ["title"])


def top_sellers(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(rank, product_id, title, quantity, bar_pct): 25 best by quantity in
    the range; bar = quantity / top quantity * 100 (0 when quantity <= 0)."""
    lines = _range_lines(shop, params, "top_sellers.items", "qty", hooks)
    per_product = lines.groupBy("product_id").agg(F.sum("qty").alias("quantity"))
    ranked = _ranked(per_product, "quantity", shop)
    top = F.max("quantity").over(Window.partitionBy())
    return ranked.select(
        "rank", "product_id", "title", F.col("quantity").cast("double").alias("quantity"),
        share_of_max(F.col("quantity"), top).alias("bar_pct"))


def top_earners(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(rank, product_id, title, line_total, bar_pct): 25 best by line totals;
    bar = round(total) / round(top total) * 100, null when the rounded top is 0."""
    lines = _range_lines(shop, params, "top_earners.items", "line_total", hooks)
    per_product = lines.groupBy("product_id").agg(F.sum("line_total").alias("line_total"))
    ranked = _ranked(per_product, "line_total", shop)
    top = F.max("line_total").over(Window.partitionBy())
    return ranked.select(
        "rank", "product_id", "title", F.col("line_total").cast("double").alias("line_total"),
        share_of_max(F.col("line_total"), top, rounded=True).alias("bar_pct"))


def chosen_with_children(shop: Shop, product_ids) -> DataFrame:
    """The chosen ids plus every post whose parent is one of them."""
    chosen = literal_ids(shop.products, product_ids, "product_id")
    children = shop.products.filter(F.col("parent_id").isin(list(product_ids))).select("product_id")
    return chosen.unionByName(children).distinct()


def product_sales_monthly(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(month yyyyMM, quantity, line_total, qty_bar, total_bar) over all history.

    Per order the chosen products' quantity and total are summed; orders
    where both are 0 are skipped.  The bar maximum is the highest value a
    month's running sum reaches as orders come in date order (it can exceed
    the month's final total when later lines are negative).
    """
    ids = chosen_with_children(shop, params.products)
    lines = items_of_orders(shop, "line_item", shop_order(), ["order_id", "product_id", "qty", "line_total"],
                            created=F.col("created"))
    lines = lines.filter(F.col("qty").isNotNull() & F.col("line_total").isNotNull()).join(ids, "product_id", "left_semi")
    lines = H.apply(hooks, "product_sales.items", lines, product_ids=params.products)
    per_order = (lines.groupBy("order_id", "created")
                 .agg(F.sum("qty").alias("qty"), F.sum("line_total").alias("total"))
                 .filter(~((F.col("qty") == 0) & (F.col("total") == 0))))
    per_month = max_running_sum(
        per_order.withColumn("month", yyyymm(F.col("created"))), ["month"],
        ["created", "order_id"], ["qty", "total"])
    # one row per month of history: the global maxima need a tiny window
    everything = Window.partitionBy()
    max_qty = F.greatest(F.max("qty_max_run").over(everything), F.lit(0))
    max_total = F.greatest(F.max("total_max_run").over(everything), F.lit(0))
    return per_month.select(
        "month", F.col("qty_sum").cast("double").alias("quantity"),
        F.col("total_sum").cast("double").alias("line_total"),
        share_of_max(F.col("qty_sum"), max_qty, rounded=True).alias("qty_bar"),
        share_of_max(F.col("total_sum"), max_total, rounded=True).alias("total_bar"))


def product_children(shop: Shop) -> DataFrame:
    """(parent_id, parent_title, child_id, child_type) for every product with
    children: the parent self-join, shuffled on the parent key."""
    p = shop.products.select(F.col("product_id").alias("parent_id"), F.col("title").alias("parent_title"))
    c = shop.products.filter(F.col("parent_id").isNotNull()).select(
        "parent_id", F.col("product_id").alias("child_id"), F.col("post_type").alias("child_type"))
    return p.join(c, "parent_id")
