"""Report 3: monthly sales of one year, the year summary, and report years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.dates import in_year, month_of, months_started_by
from ..functions.numbers import MONEY, absint, positive_or_null, round2_ratio
from ..model import DEFAULT, SHOP_ORDER, Params, Shop
from .common import completed, completed_orders, items_of_orders, tagged_union


def monthly_sales(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(month_start date, orders bigint, sales double, items bigint) for the
    months of ``params.year`` that have started by ``params.now``."""
    return _monthly(shop, params, hooks).select(
        "month_start", "orders", F.col("sales").cast("double"), "items")


def _monthly(shop: Shop, params: Params, hooks) -> DataFrame:
    """Monthly rows with sales still DECIMAL (summed exactly by the summary).

    Orders and sales count completed ``shop_order`` posts; items take line
    items of every completed post and apply abs(int()) per month.  All
    measures of all months come out of ONE global aggregation over a tagged
    union (per-month conditional sums: partial aggregates per task and a
    tiny final merge, no shuffle of rows, no calendar join); the months are
    then stacked into rows, empty ones as 0.
    """
    year = params.year
    orders = completed_orders(shop).filter(in_year(F.col("created"), year))
    orders = H.apply(hooks, "monthly.orders", orders, year=year)
    items = items_of_orders(shop, "line_item", completed() & in_year(F.col("created"), year), ["order_id", "qty"],
                            created=F.col("created"))
    items = H.apply(hooks, "monthly.items", items, year=year)
    u = tagged_union({1: orders.select("created", "total"), 2: items.select("created", "qty")},
                     {"created": "timestamp_ntz", "total": MONEY, "qty": MONEY})
    shown = months_started_by(year, params.now)
    n = max(shown, 1)
    u = u.select("src", month_of(F.col("created")).alias("month"), "total", "qty")
    aggs = []
    for m in range(1, n + 1):
        aggs += [F.expr(f"count(CASE WHEN src = 1 AND month = {m} THEN total END) AS o{m}"),
                 F.expr(f"coalesce(sum(CASE WHEN src = 1 AND month = {m} THEN total END), 0) AS s{m}"),
                 F.expr(f"sum(CASE WHEN src = 2 AND month = {m} THEN qty END) AS q{m}")]
    stack = ", ".join(f"{m}, o{m}, s{m}, q{m}" for m in range(1, n + 1))
    rows = u.agg(*aggs).selectExpr(f"stack({n}, {stack}) AS (month, orders, sales, q)").filter(
        F.col("month") <= shown)
    return rows.select(F.make_date(F.lit(year), F.col("month"), F.lit(1)).alias("month_start"),
                       F.col("orders").cast("bigint"), F.col("sales"), absint(F.col("q")).cast("bigint").alias("items"))


def monthly_sales_summary(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """Year cards: totals and averages, null ("n/a") when not positive."""
    m = _monthly(shop, params, hooks)
    agg = m.agg(F.sum("sales").alias("s"), F.sum("orders").alias("n"), F.sum("items").alias("q"))
    n, s, q = F.col("n").cast("bigint"), F.col("s"), F.col("q").cast("bigint")
    has = n > 0
    return agg.select(
        positive_or_null(s).cast("double").alias("total_sales"),
        positive_or_null(n).alias("total_orders"),
        F.when(has, q).alias("total_items"),
        F.when(has, s.cast("double") / n.cast("double")).alias("average_total"),
        F.when(has, round2_ratio(q, n)).alias("average_items"))


def report_years(shop: Shop, params: Params = DEFAULT, orders_only: bool = False) -> DataFrame:
    """Years offered by the year pickers: first dated post's year .. now's year.

    ``orders_only`` takes the first ``shop_order`` only (the coupon report).
    With no dated post the list is just the current year.
    """
    posts = shop.orders.filter(F.col("created").isNotNull())
    if orders_only:
        posts = posts.filter(F.col("post_type") == SHOP_ORDER)
    first = posts.agg(F.min("created").alias("first"))
    now_year = F.lit(params.now.year)
    first_year = F.coalesce(F.year("first"), now_year)
    years = F.when(first_year <= now_year, F.sequence(first_year, now_year)).otherwise(
        F.array().cast("array<int>"))
    return first.select(F.explode(years.cast("array<int>")).alias("year"))
