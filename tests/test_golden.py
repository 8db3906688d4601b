"""Golden values recorded in FIXTURES.md section 2 (seen in two engines)."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF0001, SF001

Q = E.queries()

TOTALS = {
    SF0001: (121452745.66, 485, 49617, 5937.5, 5278164.836, (52, 13856517.01), (433, 107596228.65)),
    SF001: (1208252054.73, 4826, 479882, 60487.5, 51149237.74, (465, 113972896.7), (4361, 1094279158.03)),
}


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_golden_totals(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("driver test data missing")
    sales, orders, items, shipping, discounts, guests, customers = TOTALS[sf]
    t = Q["totals_overview"](spark, sf).first()
    assert (t["total_sales"], t["total_orders"], t["total_items"]) == (pytest.approx(sales, abs=1e-6), orders, items)
    assert t["shippings"] == pytest.approx(shipping) and t["discounts"] == pytest.approx(discounts, abs=1e-6)
    c = Q["customer_guest_overview"](spark, sf).first()
    assert (c["total_guest_orders"], c["total_guest_sales"]) == (guests[0], pytest.approx(guests[1], abs=1e-6))
    assert (c["total_customer_orders"], c["total_customer_sales"]) == (customers[0], pytest.approx(customers[1], abs=1e-6))


@pytest.mark.skipif(not os.path.isdir(SF001), reason="driver test data missing")
def test_golden_march_and_lists_sf001(spark):
    daily = sorted(tuple(r) for r in Q["daily_sales"](spark, SF001).collect())
    assert len(daily) == 31
    assert daily[0] == (dt.date(1998, 3, 1), 3, pytest.approx(1217611.3))
    assert daily[1] == (dt.date(1998, 3, 2), 2, pytest.approx(460594.47))
    top = Q["top_sellers"](spark, SF001).filter(F.col("rank") == 1).first()
    assert (top["product_id"], top["quantity"]) == (997, 85.0)
    used = Q["coupons_most_used"](spark, SF001).filter(F.col("rank") == 1).first()
    assert (used["coupon"], used["uses"]) == ("SAVE5-N", 19)
    save5 = {r["coupon"]: r["amount"] for r in Q["coupons_greatest_discount"](spark, SF001).collect()}
    assert save5["SAVE5-N"] == pytest.approx(43837.658, abs=1e-6)
    assert Q["low_stock"](spark, SF001).count() == 114 and Q["out_of_stock"](spark, SF001).count() == 394
    economy = Q["category_closure"](spark, SF001).filter(F.col("ancestor") == "ECONOMY").count()
    assert economy == 26
    signups = dict(tuple(r) for r in Q["customer_signups_daily"](spark, SF001).collect())
    assert signups[dt.date(2024, 1, 1)] == 35


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="driver test data missing")
def test_golden_lists_sf0001(spark):
    assert Q["low_stock"](spark, SF0001).count() == 19 and Q["out_of_stock"](spark, SF0001).count() == 47
    assert Q["category_closure"](spark, SF0001).filter(F.col("ancestor") == "ECONOMY").count() == 15
    signups = dict(tuple(r) for r in Q["customer_signups_daily"](spark, SF0001).collect())
    assert signups[dt.date(2024, 1, 1)] == 4
