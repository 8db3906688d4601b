"""Hand-computed micro fixtures (FIXTURES.md section 3)."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import line, make_shop, order, rows, ts
from tillroll.model import DEFAULT
from tillroll.operators.stats import entity_stats
from tillroll.plans.categories import category_sales_monthly, category_sales_totals
from tillroll.plans.coupons import (coupon_discounts_monthly, coupon_usage_overview,
                                    coupons_greatest_discount, coupons_most_used)
from tillroll.plans.customers import customer_guest_overview, customer_signups_daily
from tillroll.plans.daily import daily_sales, daily_sales_summary
from tillroll.plans.monthly import monthly_sales
from tillroll.plans.products import product_sales_monthly
from tillroll.plans.stock import low_stock, out_of_stock
from tillroll.plans.taxes import monthly_taxes, monthly_taxes_by_rate
from tillroll.plans.totals import totals_overview

D = dt.date


# -- M1 daily range ------------------------------------------------------------

M1_ORDERS = [
    order(1, ts("2024-03-01 00:00:00"), 10),
    order(2, ts("2024-03-01 00:00:01"), 5),
    order(3, ts("2024-03-03 23:59:59"), 7.5),
    order(4, ts("2024-03-02 10:00:00"), 99, status="wc-processing"),
    order(5, ts("2024-03-04 00:00:00"), 1),
]
M1_ITEMS = [line(1, 1), line(2, 2), line(3, 1), line(3, 1), line(4, 1), line(5, 1)]
M1_PARAMS = replace(DEFAULT, start=D(2024, 3, 1), end=D(2024, 3, 3))


def test_m1_daily_range(spark):
    shop = make_shop(spark, orders=M1_ORDERS, items=M1_ITEMS)
    got = sorted(rows(daily_sales(shop, M1_PARAMS)))
    assert got == [(D(2024, 3, 1), 1, 5.0), (D(2024, 3, 2), 0, 0.0), (D(2024, 3, 3), 1, 7.5)]
    s = daily_sales_summary(shop, M1_PARAMS).first().asDict()
    assert s == {"total_sales": 12.5, "total_orders": 2, "total_items": 4,
                 "average_total": 6.25, "average_items": 2.0}


def test_m1_end_day_not_seeded(spark):
    shop = make_shop(spark, orders=[o for o in M1_ORDERS if o["order_id"] != 3], items=M1_ITEMS)
    got = sorted(rows(daily_sales(shop, M1_PARAMS)))
    assert got == [(D(2024, 3, 1), 1, 5.0), (D(2024, 3, 2), 0, 0.0)]


def test_m1_single_day_range(spark):
    shop = make_shop(spark, orders=M1_ORDERS, items=M1_ITEMS)
    params = replace(DEFAULT, start=D(2024, 3, 2), end=D(2024, 3, 2))
    assert rows(daily_sales(shop, params)) == [(D(2024, 3, 2), 0, 0.0)]


# -- M3 house median -------------------------------------------------------------

@pytest.mark.parametrize("values, null_when_two, expected", [
    ([1, 4, 9], True, 6.5),
    ([1, 2, 3, 4], True, 3.0),
    ([1, 4], True, None),
    ([1, 4], False, 4.0),
])
def test_m3_house_median(spark, values, null_when_two, expected):
    df = spark.createDataFrame([(f"e{i}", float(v)) for i, v in enumerate(values)], "name string, v double")
    got = entity_stats(df, "name", "v", F.col("name"), null_when_two).first()
    assert got["median"] == expected
    assert got["top"] == f"e{len(values) - 1}" and got["worst"] == "e0"
    assert got["average"] == pytest.approx(sum(values) / len(values))


# -- M4 category tree --------------------------------------------------------------

M4_CATS = [{"term_id": 1, "parent_id": 0, "name": "A"}, {"term_id": 2, "parent_id": 1, "name": "B"},
           {"term_id": 3, "parent_id": 0, "name": "C"}, {"term_id": 4, "parent_id": 0, "name": "D"}]
M4_MEMBERS = [{"product_id": 1, "term_id": 1}, {"product_id": 1, "term_id": 2},
              {"product_id": 2, "term_id": 2}, {"product_id": 3, "term_id": 3},
              {"product_id": 3, "term_id": 4}]


def _m4_shop(spark):
    return make_shop(spark, orders=[order(1, ts("1998-02-10 10:00:00"), 22)],
                     items=[line(1, 1, 10, 1), line(1, 1, 5, 2), line(1, 1, 7, 3)],
                     categories=M4_CATS, product_categories=M4_MEMBERS)


@pytest.mark.parametrize("chosen, row_totals, grand", [
    (("A",), {"A": 15.0, "B": 15.0}, 15.0),
    (("B",), {"B": 15.0}, 15.0),
    (("C", "D"), {"C": 7.0, "D": 7.0}, 14.0),
])
def test_m4_category_tree(spark, chosen, row_totals, grand):
    shop = _m4_shop(spark)
    params = replace(DEFAULT, category_names=chosen)
    monthly = category_sales_monthly(shop, params)
    got = {r["category"]: r["sales"] for r in monthly.filter(F.col("month").isNull()).collect()}
    assert got == row_totals
    feb = {r["category"]: r["sales"] for r in monthly.filter(F.col("month") == 2).collect()}
    assert feb == row_totals
    totals = {r["month"]: r["sales"] for r in category_sales_totals(shop, params).collect()}
    assert totals[None] == grand and totals[2] == grand and totals[1] == 0.0
    assert len(totals) == 10  # months 1..9 (now is in September) + grand total


# -- M5 stock lists -----------------------------------------------------------------

def _product(pid, kind, managed, stock, status, parent=None):
    variation = kind == "variation"
    return {"product_id": pid, "parent_id": parent,
            "post_type": "product_variation" if variation else "product", "post_status": "publish",
            "title": f"p{pid}", "product_type": None if variation else kind,
            "manage_stock": managed, "stock": stock, "stock_status": status}


M5_PRODUCTS = [
    _product(1, "simple", "yes", "3", "instock"), _product(2, "simple", "yes", "0", "instock"),
    _product(3, "simple", "yes", "", "instock"), _product(4, "variation", None, "", "instock", 1),
    _product(5, "variation", None, "2", "instock", 1), _product(6, "simple", "no", "3", "instock"),
    _product(7, "simple", "no", "50", "outofstock"), _product(8, "variable", "yes", "4", "instock"),
    _product(9, "grouped", "yes", "1", "instock"), _product(10, "simple", "yes", "0.5", "instock"),
]


def test_m5_stock_lists(spark):
    shop = make_shop(spark, products=M5_PRODUCTS)
    low = {r["product_id"]: (r["edit_id"], r["stock"]) for r in low_stock(shop).collect()}
    assert low == {1: (1, 3), 5: (1, 2), 8: (8, 4)}
    out = {r["product_id"]: r["marked"] for r in out_of_stock(shop).collect()}
    assert out == {2: False, 3: True, 7: False}
    assert not set(low) & set(out)


def test_m5_no_candidates(spark):
    shop = make_shop(spark, products=[_product(6, "simple", "no", "3", "instock")])
    assert low_stock(shop).count() == 0 and out_of_stock(shop).count() == 0


# -- M6 / M7 items ----------------------------------------------------------------

def test_m6_refund_counts_only_in_items(spark):
    shop = make_shop(spark, orders=[order(1, ts("1998-01-05 10:00:00"), 20),
                                    order(2, ts("1998-01-06 10:00:00"), 20, post_type="shop_order_refund")],
                     items=[line(1, 2), line(2, -1)])
    t = totals_overview(shop).first()
    assert (t["total_sales"], t["total_orders"], t["total_items"]) == (20.0, 1, 1)


@pytest.mark.parametrize("q1, q2, daily_items, total_items", [(2, -3, 5, 1), (1.5, 1.5, 2, 3)])
def test_m7_abs_per_order_vs_grand(spark, q1, q2, daily_items, total_items):
    params = replace(DEFAULT, start=D(1998, 3, 1), end=D(1998, 3, 31))
    shop = make_shop(spark, orders=[order(1, ts("1998-03-05 10:00:00"), 10),
                                    order(2, ts("1998-03-06 10:00:00"), 10)],
                     items=[line(1, q1), line(2, q2)])
    assert daily_sales_summary(shop, params).first()["total_items"] == daily_items
    assert totals_overview(shop).first()["total_items"] == total_items


# -- M9 coupons ----------------------------------------------------------------------

def _coupon(order_id, name, amount):
    return {"order_id": order_id, "item_type": "coupon", "item_name": name, "discount_amount": amount}


def test_m9_coupons(spark):
    params = replace(DEFAULT, start=D(1998, 3, 1), end=D(1998, 3, 31))
    orders = [order(i, ts(f"1998-03-0{i} 10:00:00"), 10) for i in (1, 2, 3, 4)]
    items = [_coupon(1, "A", 3), _coupon(1, "B", 1), _coupon(2, "A", 2), _coupon(3, "", 1)]
    shop = make_shop(spark, orders=orders, items=items,
                     coupons=[{"coupon_id": 77, "title": "A", "post_status": "publish"}])
    o = coupon_usage_overview(shop, params).first().asDict()
    assert o == {"order_count": 4, "coupon_orders": 3, "coupon_pct": 75.0, "total_discount": 7.0}
    used = [(r["coupon"], r["uses"], r["coupon_id"]) for r in coupons_most_used(shop, params).orderBy("rank").collect()]
    assert used == [("A", 2, 77), ("B", 1, None)]
    great = [(r["coupon"], r["amount"]) for r in coupons_greatest_discount(shop, params).orderBy("rank").collect()]
    assert great == [("A", 5.0), ("B", 1.0)]


# -- M10 customers -------------------------------------------------------------------

def test_m10_customer_or_guest(spark):
    orders = [order(1, ts("1998-01-01 10:00:00"), 10, customer_id=7),
              order(2, ts("1998-01-01 10:00:00"), 5, customer_id=0),
              order(3, ts("1998-01-01 10:00:00"), 3, customer_id=0),
              order(4, ts("1998-01-01 10:00:00"), 100, customer_id=None)]
    users = [{"user_id": 7, "role": "customer"}, {"user_id": 8, "role": "editor"}]
    c = customer_guest_overview(make_shop(spark, orders=orders, users=users)).first().asDict()
    assert c == {"total_customers": 1, "total_customer_sales": 10.0, "total_guest_sales": 8.0,
                 "total_customer_orders": 1, "total_guest_orders": 2, "orders_per_customer": 1.0}


def test_m10_customer_key_coercion(spark):
    from tillroll.operators.eav import eav_pivot
    meta = spark.createDataFrame([(1, "_customer_user", "7"), (2, "_customer_user", "0"),
                                  (3, "_customer_user", ""), (4, "_order_total", "5")],
                                 "post_id long, meta_key string, meta_value string")
    got = dict(rows(eav_pivot(meta, "post_id", numeric={"_customer_user": ("customer_id", "bigint"),
                                                         "_order_total": ("total", "double")})
                    .select("post_id", "customer_id")))
    assert got == {1: 7, 2: 0, 3: 0, 4: None}


# -- M11 sign-ups --------------------------------------------------------------------

def test_m11_signups(spark):
    signups = [{"user_id": 1, "role": "customer", "user_registered": ts("2024-01-01 11:00:00")},
               {"user_id": 2, "role": "customer", "user_registered": ts("2024-01-01 13:00:00")},
               {"user_id": 3, "role": "customer", "user_registered": ts("2024-01-31 09:00:00")}]
    got = dict(rows(customer_signups_daily(make_shop(spark, signups=signups))))
    assert len(got) == 31
    assert got[D(2024, 1, 1)] == 1 and got[D(2024, 1, 31)] == 1
    assert sum(got.values()) == 2


# -- M12 taxes -------------------------------------------------------------------------

def test_m12_taxes(spark):
    orders = [order(1, ts("1998-01-10 10:00:00"), 100, shipping=10, order_tax=8, shipping_tax=2)]
    items = [{"order_id": 1, "item_type": "tax", "item_name": "VAT8", "tax_amount": 8, "shipping_tax_amount": 2},
             {"order_id": 1, "item_type": "tax", "item_name": "ZERO", "tax_amount": 0, "shipping_tax_amount": 0}]
    shop = make_shop(spark, orders=orders, items=items)
    m = {r["month_start"]: r for r in monthly_taxes(shop).collect()}
    assert len(m) == 9
    jan = m[D(1998, 1, 1)]
    assert (jan["gross"], jan["shipping"], jan["order_tax"], jan["shipping_tax"], jan["total_tax"], jan["net"]) \
        == (100.0, 10.0, 8.0, 2.0, 10.0, 80.0)
    assert m[D(1998, 2, 1)]["net"] == 0.0
    rates = {r["rate"] for r in monthly_taxes_by_rate(shop).collect()}
    assert rates == {"VAT8"}


# -- M13 product history ---------------------------------------------------------------

def test_m13_product_history(spark):
    orders = [order(1, ts("1998-01-10 10:00:00"), 15), order(2, ts("1998-01-11 10:00:00"), 0)]
    items = [line(1, 1, 5, 1), line(1, 2, 10, 1), line(2, 0, 0, 1)]
    got = rows(product_sales_monthly(make_shop(spark, orders=orders, items=items),
                                     replace(DEFAULT, products=(1,))))
    assert got == [("199801", 3.0, 15.0, 100.0, 100.0)]


def test_t9_running_max_exceeds_final_total(spark):
    orders = [order(1, ts("1998-01-10 10:00:00"), 10), order(2, ts("1998-01-20 10:00:00"), 10),
              order(3, ts("1998-02-01 10:00:00"), 10)]
    items = [line(1, 4, 40, 1), line(2, -2, -20, 1), line(3, 3, 30, 1)]
    got = {r[0]: r[1:] for r in rows(product_sales_monthly(make_shop(spark, orders=orders, items=items),
                                                           replace(DEFAULT, products=(1,))))}
    # running maxima: January peaks at 4 / 40 before the refund line
    assert got["199801"] == (2.0, 20.0, 50.0, 50.0)
    assert got["199802"] == (3.0, 30.0, 75.0, 75.0)


# -- M14 coupon matrix -------------------------------------------------------------------

def test_m14_coupon_matrix(spark):
    orders = [order(1, ts("1998-02-10 10:00:00"), 10), order(2, ts("1998-11-10 10:00:00"), 10)]
    items = [_coupon(1, "A", 5), _coupon(2, "A", 4)]
    m = coupon_discounts_monthly(make_shop(spark, orders=orders, items=items),
                                 replace(DEFAULT, coupons=("A",)))
    cells = {(r["coupon"], r["month"]): r["discount"] for r in m.collect()}
    assert cells[("A", None)] == 9.0
    assert sorted(k[1] for k in cells if k[0] == "A" and k[1] is not None) == list(range(1, 10))
    assert cells[("A", 2)] == 5.0
    assert sum(v for (c, mth), v in cells.items() if c is None and mth is not None) == 5.0
    assert cells[(None, None)] == 5.0


# -- monthly: past months only, items without the post-type test ------------------------

def test_monthly_hides_future_months(spark):
    orders = [order(1, ts("1998-02-10 10:00:00"), 10),
              order(2, ts("1998-10-10 10:00:00"), 99),
              order(3, ts("1998-02-11 10:00:00"), 10, post_type="shop_order_refund")]
    items = [line(1, 2), line(2, 5), line(3, -1)]
    got = {r["month_start"]: (r["orders"], r["sales"], r["items"])
           for r in monthly_sales(make_shop(spark, orders=orders, items=items)).collect()}
    assert len(got) == 9
    assert got[D(1998, 2, 1)] == (1, 10.0, 1)
    assert got[D(1998, 3, 1)] == (0, 0.0, 0)


# -- M8 term fan-out -------------------------------------------------------------------------

def test_m8_legacy_fanout(spark):
    from tillroll.model import legacy_fanout
    params = replace(DEFAULT, start=D(1998, 3, 1), end=D(1998, 3, 31))
    shop = make_shop(spark, orders=[order(1, ts("1998-03-05 10:00:00"), 10)], items=[line(1, 1)])
    terms = spark.createDataFrame([(1, 7), (1, 8), (99, 7)], "object_id long, term_id long")
    fanned = legacy_fanout(shop, terms)
    t = totals_overview(fanned).first()
    assert (t["total_sales"], t["total_orders"], t["total_items"]) == (20.0, 2, 2)
    assert rows(daily_sales(fanned, params)) and sum(r[1] for r in rows(daily_sales(fanned, params))) == 1
    d = daily_sales_summary(fanned, params).first()
    assert (d["total_sales"], d["total_orders"], d["total_items"]) == (10.0, 1, 1)
    t0 = totals_overview(shop).first()
    assert (t0["total_sales"], t0["total_orders"]) == (10.0, 1)


def test_m8_fanout_coupon_overview_counts_orders_once(spark):
    from tillroll.model import legacy_fanout
    params = replace(DEFAULT, start=D(1998, 3, 1), end=D(1998, 3, 31))
    orders = [order(i, ts(f"1998-03-0{i} 10:00:00"), 10) for i in (1, 2)]
    shop = make_shop(spark, orders=orders, items=[_coupon(1, "A", 3)])
    terms = spark.createDataFrame([(1, 7), (1, 8)], "object_id long, term_id long")
    o = coupon_usage_overview(legacy_fanout(shop, terms), params).first().asDict()
    assert o == {"order_count": 2, "coupon_orders": 1, "coupon_pct": 50.0, "total_discount": 6.0}


def test_year_not_started_gives_no_months(spark):
    from tillroll.plans.monthly import monthly_sales_summary
    from tillroll.plans.taxes import tax_year_summary
    params = replace(DEFAULT, year=1999)  # now is in September 1998
    shop = make_shop(spark, orders=[order(1, ts("1998-02-10 10:00:00"), 10)], items=[line(1, 2)])
    assert monthly_sales(shop, params).count() == 0 and monthly_taxes(shop, params).count() == 0
    s = monthly_sales_summary(shop, params).first()
    assert (s["total_sales"], s["total_orders"], s["total_items"]) == (None, None, None)
    t = tax_year_summary(shop, params).first()
    assert (t["total_tax"], t["gross"], t["net"]) == (None, 0.0, 0.0)
