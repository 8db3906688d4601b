"""Report 11: monthly taxes, taxes by rate, year summary.

The original runs five statements per month; here each table is one
grouped pass over the year's orders (or tax items) keyed by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_year, month_of, months_started_by
from ..functions.numbers import positive_or_null
from ..model import DEFAULT, Params, Shop
from .common import completed_orders, items_of_orders, month_sums, shop_order

_MEASURES = ("gross", "shipping", "order_tax", "shipping_tax")


def _monthly(shop: Shop, params: Params) -> DataFrame:
    """The started months of the year: one global aggregation of per-month
    conditional sums (no shuffle of rows, no calendar join), stacked into
    rows; empty months are 0."""
    orders = completed_orders(shop).filter(in_year(F.col("created"), params.year)).select(
        month_of(F.col("created")).alias("month"), F.col("total").alias("gross"), "shipping",
        "order_tax", "shipping_tax")
    shown = months_started_by(params.year, params.now)
    n = max(shown, 1)
    aggs = [F.expr(f"coalesce(sum(CASE WHEN month = {m} THEN {c} END), 0) AS {c}{m}")
            for m in range(1, n + 1) for c in _MEASURES]
    stack = ", ".join(f"{m}, " + ", ".join(f"{c}{m}" for c in _MEASURES) for m in range(1, n + 1))
    out = (orders.agg(*aggs).selectExpr(f"stack({n}, {stack}) AS (month, {', '.join(_MEASURES)})")
           .filter(F.col("month") <= shown)
           .withColumn("month_start", F.make_date(F.lit(params.year), F.col("month"), F.lit(1))))
    total_tax = F.col("order_tax") + F.col("shipping_tax")
    return out.select("month_start", "month", *_MEASURES, total_tax.alias("total_tax"),
                      (F.col("gross") - F.col("shipping") - total_tax).alias("net"))


def monthly_taxes(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(month_start, gross, shipping, order_tax, shipping_tax, total_tax, net)
    for the months of the year that have started; empty months are 0."""
    m = _monthly(shop, params)
    return m.select("month_start", *[F.col(c).cast("double").alias(c)
                                     for c in (*_MEASURES, "total_tax", "net")])


def tax_year_summary(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(total_tax, product_tax, shipping_tax, gross, shipping, net): the first
    three are the year cards (null when not positive), the rest the footer."""
    m = _monthly(shop, params)
    agg = m.agg(*[F.sum(c).alias(c) for c in (*_MEASURES, "total_tax", "net")])
    return agg.select(
        positive_or_null(F.col("order_tax") + F.col("shipping_tax")).cast("double").alias("total_tax"),
        positive_or_null(F.col("order_tax")).cast("double").alias("product_tax"),
        positive_or_null(F.col("shipping_tax")).cast("double").alias("shipping_tax"),
        F.coalesce(F.col("gross"), F.lit(0)).cast("double").alias("gross"),
        F.coalesce(F.col("shipping"), F.lit(0)).cast("double").alias("shipping"),
        F.coalesce(F.col("net"), F.lit(0)).cast("double").alias("net"))


def monthly_taxes_by_rate(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(month, rate, tax, shipping_tax, total_tax) per shown month and rate
    label, plus a year row per label (month null).

    Only tax items carrying both amounts count.  A label is shown when its
    total is > 0 in some shown month and the label is not empty or "0";
    its months without tax are 0.  One grouped aggregation by label gives
    every month's three sums (months are a fixed set); rows are stacked
    from it.
    """
    shown = months_started_by(params.year, params.now)
    lines = items_of_orders(shop, "tax", shop_order() & in_year(F.col("created"), params.year),
                            ["order_id", "item_name", "tax_amount", "shipping_tax_amount"], month=month_of(F.col("created")))
    lines = lines.filter(F.col("tax_amount").isNotNull() & F.col("shipping_tax_amount").isNotNull()
                         & (F.col("month") <= shown))
    sums = (month_sums("tax_amount", shown, "t", zero=True)
            + month_sums("shipping_tax_amount", shown, "s", zero=True)
            + month_sums("tax_amount + shipping_tax_amount", shown, "a", zero=True))
    if not sums:
        return lines.sparkSession.createDataFrame(
            [], "month int, rate string, tax double, shipping_tax double, total_tax double")
    rates = lines.groupBy(F.col("item_name").alias("rate")).agg(*sums)
    some_month_positive = F.expr("greatest(" + ", ".join(f"a{m}" for m in range(1, shown + 1)) + ", 0) > 0")
    shown_rates = rates.filter(some_month_positive & F.col("rate").isNotNull() & ~F.col("rate").isin("", "0"))
    triples = ", ".join(f"{m}, t{m}, s{m}, a{m}" for m in range(1, shown + 1))
    dense = shown_rates.selectExpr(f"stack({shown}, {triples}) AS (month, tax, shipping_tax, total_tax)", "rate")
    year = shown_rates.selectExpr(
        "CAST(NULL AS INT) AS month", "rate",
        *[" + ".join(f"{k}{m}" for m in range(1, shown + 1)) + f" AS {name}"
          for k, name in (("t", "tax"), ("s", "shipping_tax"), ("a", "total_tax"))])
    out = dense.unionByName(year)
    measures = ("tax", "shipping_tax", "total_tax")
    return out.select(F.col("month").cast("int"), "rate", *[F.col(m).cast("double").alias(m) for m in measures])
