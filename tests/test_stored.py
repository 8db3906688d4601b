"""The stored model: upkeep equals a full rebuild and rewrites only touched slices."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, frame, line, make_shop, order, rows, ts
from tillroll import catalog
from tillroll.plans import categories, coupons, customers, daily, monthly, products, taxes, totals
from tillroll.session import drop_scratch
from tillroll.sources import star, stored

REPORTS = [totals.totals_overview, daily.daily_sales, daily.daily_sales_summary, monthly.monthly_sales, products.top_sellers,
           coupons.coupon_usage_overview, coupons.coupons_most_used, coupons.used_coupons, customers.customer_guest_overview,
           taxes.monthly_taxes_by_rate, categories.category_sales_totals]


def _bag(df):
    return Counter(rows(df))


def _same(model, plain, reports=REPORTS):
    for name in ("orders", "items"):
        columns = getattr(plain, name).columns
        assert _bag(getattr(model, name).select(*columns)) == _bag(getattr(plain, name)), name
    for report in reports:
        assert _bag(report(model)) == _bag(report(plain)), report.__name__


def _merged(shop, orders=None, items=None):
    """The model with the given orders, and the items of the given ones, replaced."""
    def put(old, new):
        return old if new is None else old.join(new.select("order_id").distinct(), "order_id", "left_anti").select(
            *old.columns).unionByName(new)
    return shop.with_(orders=put(shop.orders, orders), items=put(shop.items, items))


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_refresh_equals_a_full_rebuild(spark):
    plain = star.load_shop(spark, SF0001)
    folder = tempfile.mkdtemp(prefix="tillroll-stored-")
    model = stored.store_shop(plain, folder, 8, coupons=star.coupon_dim)
    _same(model, plain, [])
    first = _files(folder)

    # totals and status of some March orders change, and the items of two of them
    march = plain.orders.filter((F.col("created") > "1998-03-01") & (F.col("created") < "1998-03-10"))
    changed = march.withColumns({"total": F.col("total") + 1, "status": F.when(F.col("order_id") % 2 == 0, F.col("status")).otherwise("wc-completed")})
    few = [r[0] for r in changed.select("order_id").orderBy("order_id").limit(2).collect()]
    new_items = plain.items.filter(F.col("order_id").isin(few)).withColumn("qty", F.col("qty") * 3).unionByName(
        frame(spark, "items", [{"order_id": few[0], "item_type": "coupon", "item_name": "SAVE1-N", "discount_amount": "2.5"}]))
    want = _merged(plain, changed, new_items)
    touched = model.refresh(changed, new_items)
    _same(model, want, REPORTS[1:3])
    assert 0 < sum(t.startswith("orders/") for t in touched) <= 2 and 0 < sum(t.startswith("items/") for t in touched) <= 2
    assert first < _files(folder)  # the other slices are the same files

    # an order moves to another year, one gets no date, a new day is appended
    moved = want.orders.filter(F.col("order_id").isin(few)).withColumn("created", F.when(
        F.col("order_id") == few[0], F.lit(dt.datetime(1993, 5, 5)).cast("timestamp_ntz")))
    later = frame(spark, "orders", [order(10 ** 9 + i, ts(f"2003-01-0{1 + i} 10:00:00"), 12.5, customer_id=3) for i in range(3)])
    later_items = frame(spark, "items", [line(10 ** 9 + i, 2, 5) for i in range(3)])
    want = _merged(want, moved, None)
    want = want.with_(orders=want.orders.unionByName(later), items=want.items.unionByName(later_items))
    had = {name: set(model._manifest[name]["slices"]) for name in ("orders", "items")}
    touched = model.refresh(moved.unionByName(later), later_items)
    _same(model, want)
    assert len(touched) < 10 and all(any(t.startswith(n) and t.split("/")[1] not in had[n] for t in touched) for n in had)

    # a session that opens the folder later reads it as it is; old versions can go
    again = stored.store_shop(plain, folder, 8, coupons=star.coupon_dim)
    _same(again, want, REPORTS[1:2])
    assert model.drop_old() > 0
    _same(again, want, [])
    assert model.refresh() == [] and _bag(model.orders) == _bag(again.orders)


def test_a_refresh_that_fails_leaves_the_old_model(spark, monkeypatch):
    shop = make_shop(spark, orders=[order(i, ts(f"1998-03-0{i} 10:00:00"), 10) for i in range(1, 6)],
                     items=[line(i, 1, 10) for i in range(1, 6)])
    folder = tempfile.mkdtemp(prefix="tillroll-stored-")
    model = stored.store_shop(shop, folder, 2)
    before = _bag(model.orders), _bag(model.items)
    change = frame(spark, "orders", [order(1, ts("1998-03-02 10:00:00"), 99)])

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(stored, "publish", crash)
        with pytest.raises(RuntimeError):
            model.refresh(change)
    fresh = stored.store_shop(shop, folder, 2)
    assert (_bag(fresh.orders), _bag(fresh.items)) == before
    # two writers: the second one is told
    other = stored.store_shop(shop, folder, 2)
    fresh.refresh(change)
    with pytest.raises(RuntimeError):
        other.refresh(change)
    assert _bag(fresh.orders.select(*shop.orders.columns)) == _bag(_merged(shop, change).orders)


def test_many_appends_are_written_together(spark):
    shop = make_shop(spark, orders=[order(i, ts("1998-03-01 10:00:00"), 10) for i in range(4)], items=[line(i, 1, 10) for i in range(4)])
    model = stored.store_shop(shop, tempfile.mkdtemp(prefix="tillroll-stored-"), 2)
    want = 4
    for day in range(2, 8):
        model.refresh(frame(spark, "orders", [order(100 + day, ts(f"1998-03-0{day} 10:00:00"), 10)]),
                      frame(spark, "items", [line(100 + day, 1, 10)]))
        want += 1
        assert model.orders.count() == model.items.count() == want
        assert len(model._manifest["orders"]["slices"]) <= 5
    empty = stored.store_shop(make_shop(spark), tempfile.mkdtemp(prefix="tillroll-stored-"), 2)
    assert empty.orders.count() == 0
    empty.refresh(frame(spark, "orders", [order(1, ts("1998-03-01 10:00:00"), 10)]))
    assert rows(empty.orders.select("order_id", "line_qty")) == [(1, None)]


def test_reports_of_a_session_see_changed_tables(spark):
    folder = tempfile.mkdtemp(prefix="tillroll-tables-")
    for name in star.TABLES:
        shutil.copy(f"{SF0001}/{name}.parquet", f"{folder}/{name}.parquet")
    report = catalog.queries()["totals_overview"]
    before = rows(report(spark, folder))
    assert catalog.shop(spark, folder) is catalog.shop(spark, folder)
    half = spark.read.parquet(f"{SF0001}/orders.parquet").filter("o_orderkey % 2 = 0").toPandas()
    half["o_orderdate"] = half["o_orderdate"].astype("datetime64[us]")
    half.to_parquet(f"{folder}/orders.parquet")
    after = rows(report(spark, folder))
    assert after != before and after == rows(totals.totals_overview(star.load_shop(spark, folder)))
    # dropped folders are stored anew
    drop_scratch(spark)
    assert rows(report(spark, folder)) == after
    assert rows(catalog.queries()["eav_pivot_orders"](spark, SF0001).limit(0)) == []


def test_overviews_read_no_items(spark):
    plan = catalog.queries()["daily_sales_summary"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    plan += catalog.queries()["coupon_usage_overview"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" not in plan and "item_type" not in plan
