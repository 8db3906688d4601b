"""Rows without a key, repeated keys, deep trees, late rows: what the original's
inner joins and full recomputation give."""

from __future__ import annotations

import tempfile
from datetime import date
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import line, make_shop, order, rows, ts
from tillroll.model import DEFAULT
from tillroll.operators.eav import duplicate_keys, eav_pivot
from tillroll.plans import categories, customers, daily, monthly, products, totals
from tillroll.sources import eav
from tillroll.streaming import daily as streams

DAY = ts("1998-03-05 10:00:00")


@pytest.fixture(scope="module")
def gaps(spark):
    """Two orders, one without a total; lines without product, quantity or total."""
    orders = [order(1, DAY, 10, customer_id=7), order(2, DAY, None, customer_id=7, shipping=3)]
    items = [line(1, 2, 5, 1), line(1, 50, 9, None), {**line(1, 1, 7, 2), "qty": None}, {**line(1, 4, 0, 3), "line_total": None}]
    return make_shop(spark, orders=orders, items=items, users=[{"user_id": 7, "role": "customer"}])


def test_orders_without_a_total_are_not_counted(gaps):
    t = totals.totals_overview(gaps).first()
    assert (t["total_orders"], t["total_sales"], t["average_total"], t["shippings"]) == (1, 10.0, 10.0, 3.0)
    assert [(r["orders"], r["amount"]) for r in daily.daily_sales(gaps).collect() if r["orders"]] == [(1, 10.0)]
    assert daily.daily_sales_summary(gaps).first()["total_orders"] == 1
    assert [(r["orders"], r["sales"]) for r in monthly.monthly_sales(gaps).collect() if r["orders"]] == [(1, 10.0)]
    c = customers.customer_guest_overview(gaps).first()
    assert (c["total_customer_orders"], c["total_customer_sales"]) == (1, 10.0)


def test_lines_without_product_or_measure_have_no_row(gaps):
    assert sorted((r["product_id"], r["quantity"]) for r in products.top_sellers(gaps).collect()) == [(1, 2.0), (3, 4.0)]
    assert sorted((r["product_id"], r["line_total"]) for r in products.top_earners(gaps).collect()) == [(1, 5.0), (2, 7.0)]
    history = products.product_sales_monthly(gaps).collect()
    assert [(r["month"], r["quantity"], r["line_total"]) for r in history] == [("199803", 2.0, 5.0)]


def test_identifiers_are_not_added_up(spark):
    meta = spark.createDataFrame([(1, "_product_id", "5"), (1, "_product_id", "5"), (1, "_qty", "2"), (1, "_qty", "3")],
                                 "id long, meta_key string, meta_value string")
    got = eav_pivot(meta, "id", numeric={"_product_id": ("product_id", "bigint"), "_qty": ("qty", "decimal(18,4)")}).first()
    assert (got["product_id"], got["qty"]) == (5, 5)
    assert sorted(rows(duplicate_keys(meta, "id", ["_product_id", "_qty"]))) == [(1, "_product_id", 2), (1, "_qty", 2)]


def test_rollup_reaches_every_level(spark):
    cats = [{"term_id": 1, "parent_id": 0, "name": "A"}, {"term_id": 2, "parent_id": 1, "name": "B"}, {"term_id": 3, "parent_id": 2, "name": "C"},
            {"term_id": 9, "parent_id": 0, "name": "Z"}]
    members = [{"product_id": p, "term_id": t} for p, t in ((1, 1), (2, 2), (3, 3), (3, 2))]
    shop = make_shop(spark, orders=[order(1, DAY, 22)], items=[line(1, 1, 10, 1), line(1, 1, 5, 2), line(1, 1, 7, 3), line(1, 1, 90, 4)],
                     categories=cats, product_categories=members)
    got = {(r["category"], r["month"], r["level"]): r["sales"] for r in categories.sales_rollup(shop).collect()}
    assert got == {("A", 3, 0): 22.0, ("A", None, 1): 22.0, (None, 3, 2): 22.0, (None, None, 3): 22.0}


def test_lists_come_in_order(spark):
    shop = make_shop(spark, orders=[order(i, ts(f"1998-03-{31 - i:02d} 10:00:00"), i) for i in range(1, 20)])
    days = [r["day"] for r in daily.daily_sales(shop).collect()]
    assert days == sorted(days)


def test_unknown_hook_is_refused(gaps):
    with pytest.raises(KeyError, match="totals.order"):
        totals.totals_overview(gaps, hooks={"totals.order": lambda df, **_: df})


def test_database_options():
    opts = eav.jdbc_options("wp_", "postmeta", {"url": "jdbc:mysql://db/shop", "lowerBound": 0, "upperBound": 100, "numPartitions": 4})
    assert opts["dbtable"] == "wp_postmeta" and opts["partitionColumn"] == "post_id" and opts["numPartitions"] == "4"
    assert opts["customSchema"] == eav.RAW_SCHEMAS["postmeta"]
    assert "partitionColumn" not in eav.jdbc_options("", "posts", {"url": "x"})


def test_export_ids_never_meet():
    kinds = [{eav.post_id(k, kind) for k in (0, 1, 10 ** 9, 10 ** 9 + 7, 10 ** 12)}
             for kind in (eav.ORDER_KIND, eav.PRODUCT_KIND, eav.COUPON_KIND)]
    assert len(set().union(*kinds)) == 15


def _orders(spark, folder, days):
    base = spark.createDataFrame([(i, 1, "F", 5.0, ts(f"{d} 00:00:00"), "5-LOW") for i, d in days],
                                 "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    base.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("as_uri", [False, True])
def test_rows_count_however_late(spark, as_uri):
    top = tempfile.mkdtemp(prefix="tillroll-late-")
    for i, day in ((1, "2011-05-01"), (2, "2011-05-02"), (3, "1996-05-03")):
        _orders(spark, f"{top}/orders.parquet", [(i, day)])  # a table that is a folder of part files
    params = replace(DEFAULT, start=date(1995, 1, 1), end=date(2012, 1, 1))
    base = f"file://{top}/stream" if as_uri else f"{top}/stream"
    paths = streams.StreamPaths(f"{base}/checkpoint", f"{base}/sink")
    streams.run_daily_sales_stream(spark, top, params, paths=paths, glob="orders.parquet", max_files=1)
    got = streams.read_daily_sales(spark, paths, params)
    assert got.agg(F.sum("orders")).first()[0] == 3


def test_stream_without_rows_reads_as_empty(spark):
    top = tempfile.mkdtemp(prefix="tillroll-none-")
    _orders(spark, f"{top}/orders.parquet", [(1, "2011-05-01")])
    paths = streams.run_daily_sales_stream(spark, top, glob="orders.parquet")
    assert streams.read_daily_sales(spark, paths).agg(F.sum("orders")).first()[0] == 0


def test_scratch_is_dropped(spark, tmp_path, monkeypatch):
    from tillroll import session
    monkeypatch.setattr(session, "_SCRATCH", [])
    kept = session.write_table(spark.range(3), "gone")
    (folder,) = session._SCRATCH
    assert kept.count() == 3 and session.drop_scratch(spark) == 1 and session._SCRATCH == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
