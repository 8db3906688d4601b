"""Operator-level queries: EAV pivots and semi-joins over the raw export,
text coercion, the hook registry and chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_millis
from ..functions.numbers import MONEY, mysql_money, mysql_number
from ..model import DEFAULT, Params, Shop
from ..sources import eav
from ..operators.charts import chart_series
from . import categories, coupons, customers, monthly, totals

_MONEY_OUT = ("total", "shipping", "order_tax", "shipping_tax", "order_discount", "cart_discount")
_ITEM_MONEY = ("qty", "line_total", "discount_amount", "tax_amount", "shipping_tax_amount")


def eav_pivot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rebuilt from the raw export by one pivot of the order meta."""
    o = eav.raw_orders(eav.exported_raw(spark, sf_dir))
    o = o.withColumn("order_id", eav.source_key(F.col("order_id")))
    return o.select("order_id", "post_type", "status", "created",
                    *[F.col(c).cast("double").alias(c) for c in _MONEY_OUT], "customer_id")


def eav_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, meta_key, n): the order keys that an export has more than once, from
    the pivot's own pass.  The export is the shop's with some rows written twice (the
    total and customer of posts whose id leaves 3 over 97) or three times (the tax of
    those that leave 5 over 389)."""
    raw = eav.exported_raw(spark, sf_dir)
    meta, post = raw.postmeta, F.col("post_id")
    once = meta.filter((post % 97 == 3) & F.col("meta_key").isin("_order_total", "_customer_user"))
    twice = meta.filter((post % 389 == 5) & (F.col("meta_key") == "_order_tax"))
    o = eav.raw_orders(raw.with_tables(postmeta=meta.unionByName(once).unionByName(twice).unionByName(twice)), repeated="repeated")
    return o.select(eav.source_key(F.col("order_id")).alias("order_id"), F.explode("repeated").alias("meta_key", "n"))


def eav_pivot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items rebuilt from the raw export by one pivot of the item meta."""
    # both tables lie in the same ranges of ids: their join needs no other partitioning
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    i = eav.raw_items(eav.exported_raw(spark, sf_dir))
    i = i.withColumns({c: eav.source_key(F.col(c)) for c in ("order_id", "product_id")})
    return i.select("order_item_id", "order_id", "item_type", "item_name", "product_id",
                    *[F.col(c).cast("double").alias(c) for c in _ITEM_MONEY])


def customer_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_group, orders, sales): completed orders whose id is IN the
    posts with a customer key > 0 (customer) or = 0 (guest), as left-semi
    joins over the raw post meta."""
    raw = eav.exported_raw(spark, sf_dir)
    posts = raw.posts.filter((F.col("post_type") == "shop_order") & (F.col("post_status") == "wc-completed"))
    meta = raw.postmeta
    totals_ = meta.filter(F.col("meta_key") == "_order_total").select(
        F.col("post_id").alias("ID"), mysql_money(F.col("meta_value")).alias("total"))
    orders = posts.select("ID").join(totals_, "ID")
    # one pass for both groups: per order whether it is IN either list
    v = mysql_number(F.col("meta_value"))
    lists = meta.filter(F.col("meta_key") == "_customer_user").groupBy(F.col("post_id").alias("ID")).agg(
        F.max(v > 0).alias("customer"), F.max(v == 0).alias("guest"))
    sums = orders.join(lists, "ID").agg(*[
        a for g in ("customer", "guest") for a in (F.count(F.when(F.col(g), 1)).alias(f"{g}_n"),
                                                   F.sum(F.when(F.col(g), F.col("total"))).alias(f"{g}_s"))])
    return sums.selectExpr("stack(2, 'customer', customer_n, customer_s, 'guest', guest_n, guest_s) AS (customer_group, orders, sales)").select(
        "customer_group", F.col("orders").cast("bigint"), F.col("sales").cast("double"))


def mysql_number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meta_key, n, total): every raw meta text coerced with MySQL's rules
    ("" and "yes" -> 0, "-4" -> -4, "SKU12" -> 0) and summed per key."""
    raw = eav.exported_raw(spark, sf_dir)
    meta = raw.postmeta.select("meta_key", "meta_value").unionByName(
        raw.order_itemmeta.select("meta_key", "meta_value"))
    return meta.groupBy("meta_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(mysql_money(F.col("meta_value"))).cast("double").alias("total"))


def hook_override(shop: Shop) -> DataFrame:
    """Totals with a hook dropping urgent orders (shipping 25) from the sales
    and order counts only; discounts, shipping and items are untouched."""
    return totals.totals_overview(
        shop, hooks={"totals.orders": lambda df: df.filter(F.col("shipping") != F.lit(25).cast(MONEY))})


def chart_series_monthly(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(series, points): the monthly chart's two series as JSON text
    ``[[epoch_ms,value],...]`` (12 points at most per series)."""
    m = monthly._monthly(shop, params, None)
    ms = epoch_millis(F.col("month_start"))
    counts = m.select(F.lit("order_counts").alias("series"), ms.alias("ms"),
                      F.col("orders").cast("string").alias("v"))
    amounts = m.select(F.lit("order_amounts").alias("series"), ms.alias("ms"),
                       F.col("sales").cast("decimal(20,2)").cast("string").alias("v"))
    return chart_series(counts.unionByName(amounts), ["series"], F.col("ms"), F.col("v"))


def chart_series_signups(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(series, points): the sign-ups chart, one point per day (31 at most)."""
    days = customers.customer_signups_daily(shop, params).withColumn("series", F.lit("signups"))
    return chart_series(days, ["series"], epoch_millis(F.col("day")), F.col("signups"))


def chart_series_categories(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(series, points): one series per kept category of the category
    matrix, one point per shown month (sales as cents-exact text)."""
    m = categories.category_sales_monthly(shop, params).filter(F.col("month").isNotNull())
    x = epoch_millis(F.make_date(F.lit(params.year), F.col("month"), F.lit(1)))
    return chart_series(m.withColumnRenamed("category", "series"), ["series"], x,
                        F.col("sales").cast("decimal(20,2)"))


def chart_series_coupons(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(series, points): one series per coupon of the coupon matrix, one
    point per shown month (discounts carry 4 decimals, so 4-place text)."""
    m = coupons.coupon_discounts_monthly(shop, params).filter(
        F.col("coupon").isNotNull() & F.col("month").isNotNull())
    x = epoch_millis(F.make_date(F.lit(params.year), F.col("month"), F.lit(1)))
    return chart_series(m.withColumnRenamed("coupon", "series"), ["series"], x,
                        F.col("discount").cast("decimal(20,4)"))
