"""Every documented hook point is reached by its report, and a hook's frame
replaces the original one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tillroll import hooks as H
from tillroll.plans import categories, coupons, customers, daily, monthly, products, stock, totals
from tillroll.sources import star

REPORT_OF = {
    "totals.orders": totals.totals_overview, "totals.discounts": totals.totals_overview,
    "totals.shipping": totals.totals_overview, "totals.items": totals.totals_overview,
    "daily.orders": daily.daily_sales, "daily.order_items": daily.daily_sales_summary,
    "monthly.orders": monthly.monthly_sales, "monthly.items": monthly.monthly_sales,
    "top_sellers.items": products.top_sellers, "top_earners.items": products.top_earners,
    "product_sales.items": products.product_sales_monthly,
    "coupons.orders": coupons.coupon_usage_overview, "coupons.items": coupons.coupons_most_used,
    "coupons.totals": coupons.coupon_usage_overview, "coupons.most_used": coupons.coupons_most_used,
    "coupons.greatest_discount": coupons.coupons_greatest_discount,
    "coupons.used": coupons.used_coupons, "coupons.monthly": coupons.coupon_discounts_monthly,
    "customers.customer_orders": customers.customer_guest_overview,
    "customers.guest_orders": customers.customer_guest_overview,
    "stock.candidates": stock.low_stock, "categories.items": categories.category_sales_monthly,
}


@pytest.fixture(scope="module")
def shop(spark):
    return star.load_shop(spark, SF0001)


def test_every_point_has_a_report():
    assert set(REPORT_OF) == set(H.POINTS)


@pytest.mark.parametrize("point", sorted(H.POINTS))
def test_point_is_reached(shop, point):
    seen = []

    def hook(df, **context):
        seen.append(context)
        return df
    REPORT_OF[point](shop, hooks={point: hook})  # hooks run while the plan is built
    assert len(seen) == 1


def test_hook_frame_replaces_the_original(shop):
    none = daily.daily_sales(shop, hooks={"daily.orders": lambda df, **ctx: df.filter(F.lit(False))})
    assert none.agg(F.sum("orders")).first()[0] == 0
    assert daily.daily_sales(shop).agg(F.sum("orders")).first()[0] > 0


def test_unknown_point_is_rejected(shop):
    with pytest.raises(KeyError):
        H.apply({"no.such.point": lambda df: df}, "no.such.point", shop.orders)
