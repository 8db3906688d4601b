"""Reports 7-8: coupon overview, top coupons, coupon x month matrix, stats.

None of the coupon statements tests the post type: any completed post
(refunds included) counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.dates import after_start_before_end_day, in_year, matrix_months, month_of
from ..functions.numbers import positive_or_null, round2_percent
from ..model import DEFAULT, Params, Shop
from ..operators.ranking import lookup_bounded, top_k
from ..operators.stats import entity_stats
from .common import completed, date_hint, items_of, items_of_orders, month_sums

TOP = 15


def _range(params: Params):
    return lambda c: after_start_before_end_day(c, params.start, params.end)


def _posts_in_range(shop: Shop, params: Params, hooks) -> DataFrame:
    posts = shop.orders.filter(
        completed() & after_start_before_end_day(F.col("created"), params.start, params.end)).select("order_id")
    return H.apply(hooks, "coupons.orders", posts, start=params.start, end=params.end)


def _coupon_items(shop: Shop, hint=None) -> DataFrame:
    items = items_of(shop, "coupon")
    if hint is not None:
        items = date_hint(items, hint)
    return items.filter(F.col("discount_amount").isNotNull()).select(
        "order_id", F.col("item_name").alias("coupon"), "discount_amount")


def _items_of_posts(shop: Shop, condition, **keep) -> DataFrame:
    """(order_id, coupon, discount_amount) of completed posts that meet the condition."""
    items = items_of_orders(shop, "coupon", completed() & condition, ["order_id", "item_name", "discount_amount"], **keep)
    return items.filter(F.col("discount_amount").isNotNull()).withColumnRenamed("item_name", "coupon")


def coupon_usage_overview(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(order_count, coupon_orders, coupon_pct, total_discount).

    The stored model's orders carry the number and sum of their coupon items.
    Otherwise coupon items are reduced to one row per order first (map-side
    combine, so an order with very many coupon lines cannot skew the join), then
    left-joined to the range's completed posts.  All is summed globally; the
    last three are null ("n/a") when not positive.
    """
    if "coupon_uses" in shop.orders.columns and not set(hooks or ()) & {"coupons.orders", "coupons.items", "coupons.totals"}:
        posts = shop.orders.filter(completed() & _range(params)(F.col("created")))
        per_post = posts.select("order_id", F.col("coupon_uses").alias("k"), F.col("coupon_discount").alias("d"))
    else:
        posts = _posts_in_range(shop, params, hooks)
        items = H.apply(hooks, "coupons.items", _coupon_items(shop, _range(params)), start=params.start, end=params.end)
        items = H.apply(hooks, "coupons.totals", items, start=params.start, end=params.end)
        per_order = items.groupBy("order_id").agg(
            F.count("discount_amount").alias("k"), F.sum("discount_amount").alias("d"))
        per_post = posts.join(per_order, "order_id", "left")
    if shop.fanout:
        # repeated posts: orders are counted once, the discount once per copy
        per_post = per_post.groupBy("order_id").agg(F.max("k").alias("k"), F.sum("d").alias("d"))
    agg = per_post.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k") > 0, F.lit(1))).alias("c"),
                       F.sum("d").alias("d"))
    c, n = F.col("c"), F.col("n")
    return agg.select(
        n.cast("bigint").alias("order_count"),
        positive_or_null(c).cast("bigint").alias("coupon_orders"),
        F.when(c > 0, round2_percent(c, n)).alias("coupon_pct"),
        positive_or_null(F.col("d")).cast("double").alias("total_discount"))


def _named_in_range(shop: Shop, params: Params, hooks, point: str) -> DataFrame:
    """Named coupon items in range; ``point`` is the list's own hook, after the
    one that all coupon lists share."""
    if hooks and "coupons.orders" in hooks:
        items = _coupon_items(shop, _range(params)).join(_posts_in_range(shop, params, hooks), "order_id")
    else:
        items = _items_of_posts(shop, _range(params)(F.col("created")))
    items = items.filter(F.col("coupon") != "")
    items = H.apply(hooks, "coupons.items", items, start=params.start, end=params.end)
    return H.apply(hooks, point, items, start=params.start, end=params.end)


def coupon_lookup(shop: Shop) -> DataFrame:
    """Coupon name -> id of a published coupon post (the lowest id when
    several share the title)."""
    return (shop.coupons.filter(F.col("post_status") == "publish")
            .groupBy(F.col("title").alias("coupon")).agg(F.min("coupon_id").alias("coupon_id")))


def coupons_most_used(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(rank, coupon, uses, coupon_id): 15 most used names in the range
    (ties: name ascending)."""
    per = _named_in_range(shop, params, hooks, "coupons.most_used").groupBy("coupon").agg(F.count(F.lit(1)).alias("uses"))
    best = top_k(per, TOP, [F.col("uses").desc(), F.col("coupon").asc()])
    return lookup_bounded(best, coupon_lookup(shop), "coupon", ["coupon_id"]).select(
        "rank", "coupon", F.col("uses").cast("bigint"), "coupon_id")


def coupons_greatest_discount(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(rank, coupon, amount, coupon_id): 15 names with the largest discount."""
    per = _named_in_range(shop, params, hooks, "coupons.greatest_discount").groupBy("coupon").agg(
        F.sum("discount_amount").alias("amount"))
    best = top_k(per, TOP, [F.col("amount").desc(), F.col("coupon").asc()])
    return lookup_bounded(best, coupon_lookup(shop), "coupon", ["coupon_id"]).select(
        "rank", "coupon", F.col("amount").cast("double"), "coupon_id")


def used_coupons(shop: Shop, hooks=None) -> DataFrame:
    """Every coupon name used on a completed post (all time), by name."""
    items = _items_of_posts(shop, F.lit(True)).filter(F.col("coupon") != "")
    return H.apply(hooks, "coupons.used", items.select("coupon").distinct()).orderBy("coupon")


def used_coupon_lookup(shop: Shop) -> DataFrame:
    """(coupon, coupon_id) for every used coupon; id null when no post."""
    return used_coupons(shop).join(coupon_lookup(shop), "coupon", "left")


def _chosen(items: DataFrame, coupons) -> DataFrame:
    if coupons is None:
        return items.filter(F.col("coupon") != "")
    return items.filter(F.col("coupon").isin(list(coupons)))


def _year_items(shop: Shop, params: Params, hooks) -> DataFrame:
    """(coupon, month, discount_amount): the year's items of chosen coupons."""
    items = _chosen(_items_of_posts(shop, in_year(F.col("created"), params.year), month=month_of(F.col("created"))), params.coupons)
    return H.apply(hooks, "coupons.monthly", items, year=params.year)


def _coupon_rows(shop: Shop, params: Params, hooks) -> DataFrame:
    """One row per coupon with a sale in the year: m1..m12 (that month's
    discount, null when none) and the year total — one grouped aggregation
    (months are a fixed set of twelve)."""
    items = _year_items(shop, params, hooks)
    return items.groupBy("coupon").agg(*month_sums("discount_amount", 12, "m"),
                                       F.sum("discount_amount").alias("total"))


def _stack_months(shown: int, prefix: str = "m") -> str:
    pairs = ", ".join(f"{m}, coalesce({prefix}{m}, 0)" for m in range(1, shown + 1))
    return f"stack({shown}, {pairs}) AS (month, d)"


def coupon_discounts_monthly(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """Long form of the coupon x month matrix: (coupon, month, discount).

    * (c, m): coupon c's discount in shown month m (0 when none);
    * (c, null): c's row total over ALL months of the year, hidden ones too;
    * (null, m): column total over the shown months;
    * (null, null): sum of the column totals.
    Coupons without a sale in the year have no row.  Everything comes from
    one aggregation to one row per coupon; the column totals are a global
    aggregate over those rows.
    """
    rows = _coupon_rows(shop, params, hooks)
    shown = matrix_months(params.year, params.now)
    dense = rows.selectExpr("coupon", _stack_months(shown))
    totals = rows.select("coupon", F.lit(None).cast("int").alias("month"), F.col("total").alias("d"))
    cols = rows.agg(*[F.expr(f"sum(m{m}) AS m{m}") for m in range(1, shown + 1)])
    columns = cols.selectExpr("CAST(NULL AS STRING) AS coupon", _stack_months(shown))
    grand = cols.selectExpr("CAST(NULL AS STRING) AS coupon", "CAST(NULL AS INT) AS month",
                            " + ".join(f"coalesce(m{m}, 0)" for m in range(1, shown + 1)) + " AS d")
    out = dense.unionByName(totals).unionByName(columns).unionByName(grand)
    return out.select("coupon", F.col("month").cast("int"), F.col("d").cast("double").alias("discount"))


def coupon_discounts_stats(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(top, top_total, worst, worst_total, average, median) over the coupon
    row totals; a row only when more than one coupon has sales.  Ties go to
    the coupon chosen first (name order when every coupon is chosen)."""
    rows = _coupon_rows(shop, params, hooks).select("coupon", "total")
    if params.coupons is None:
        tie = F.col("coupon")
    else:
        tie = F.array_position(F.array(*[F.lit(c) for c in params.coupons]), F.col("coupon")).cast("string")
        tie = F.lpad(tie, 10, "0")
    stats = entity_stats(rows, "coupon", "total", tie, null_median_when_two=True)
    return stats.filter(F.col("n") > 1).select("top", "top_total", "worst", "worst_total", "average", "median")
