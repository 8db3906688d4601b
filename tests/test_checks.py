"""Coercion that saturates and is counted, repeated keys found in the pivot, published results."""

from __future__ import annotations

import tempfile
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import Observation

from conftest import SF0001, make_shop, order, rows, ts
from tillroll import publish as publishing
from tillroll.functions.numbers import MONEY, mysql_number
from tillroll.model import DEFAULT
from tillroll.operators.eav import eav_pivot
from tillroll.plans import daily, totals
from tillroll.sources import eav

TOP = Decimal("99999999999999.9999")


@pytest.mark.parametrize("text,money,whole", [
    ("1e40", TOP, (1 << 63) - 1), ("-1e40", -TOP, -(1 << 63)), ("9" * 60, TOP, (1 << 63) - 1), ("1e999999", TOP, (1 << 63) - 1),
    ("-1e400x", -TOP, -(1 << 63)), ("1e-50", 0, 0), ("1e-999999", 0, 0), ("99999999999999.99994", TOP, 99999999999999),
    ("100000000000000", TOP, 10 ** 14), ("12.5abc", Decimal("12.5"), 12), ("", 0, 0), (None, None, None)])
def test_numbers_beyond_the_type_are_its_bound(spark, text, money, whole):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(mysql_number("t", MONEY), mysql_number("t", "bigint")).first()) == (money, whole)


def test_a_malformed_total_is_counted_and_the_report_returns(spark):
    raw = eav.exported_raw(spark, SF0001)
    victim = raw.posts.filter("post_type = 'shop_order' AND post_status = 'wc-completed'").selectExpr("min(ID)").first()[0]
    plain = totals.totals_overview(eav.raw_to_shop(raw)).first()
    meta = raw.postmeta.filter(f"NOT (post_id = {victim} AND meta_key = '_order_total')").unionByName(spark.createDataFrame(
        [(victim, "_order_total", "1e40"), (victim, "_order_discount", "7 off"), (victim, "_cart_discount", "free")], raw.postmeta.schema))
    checks = Observation("coercion")
    shop = eav.raw_to_shop(replace(raw, postmeta=meta), checks=checks)
    shop.orders.write.format("noop").mode("overwrite").save()
    assert {k: v for k, v in checks.get.items() if k != "values"} == {"not_numbers": 1, "cut": 1, "saturated": 1}
    got = totals.totals_overview(eav.raw_to_shop(replace(raw, postmeta=meta))).first()
    assert got[0] > plain[0] and got[0] >= float(TOP)


def test_repeated_keys_and_sums_that_saturate(spark):
    meta = spark.createDataFrame([(1, "a", "9e13"), (1, "a", "9e13"), (1, "b", "x"), (2, "a", "3"), (3, "b", "y"), (3, "b", "z"), (4, "c", "1")],
                                 "id long, meta_key string, meta_value string")
    got = eav_pivot(meta, "id", numeric={"a": ("amount", MONEY)}, text={"b": "label"}, repeated="again")
    assert sorted(rows(got)) == [(1, TOP, "x", {"a": 2}), (2, Decimal(3), None, None), (3, None, "z", {"b": 2})]


def test_published_results(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="tillroll-results-")
    shop = make_shop(spark, orders=[order(1, ts("1998-03-02 10:00:00"), 10)])
    read = lambda params=DEFAULT: publishing.read_report(spark, folder, "daily_sales", params)
    assert read() is None
    for n in range(4):
        assert publishing.publish_report(daily.daily_sales(shop), folder, "daily_sales", DEFAULT) == n
    want = sorted(rows(daily.daily_sales(shop)))
    assert sorted(rows(read())) == want and read(replace(DEFAULT, year=1997)) is None
    changed = make_shop(spark, orders=[order(1, ts("1998-03-02 10:00:00"), 99)])

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(publishing, "publish", crash)
        with pytest.raises(RuntimeError):
            publishing.publish_report(daily.daily_sales(changed), folder, "daily_sales", DEFAULT)
    assert sorted(rows(read())) == want
    publishing.publish_report(daily.daily_sales(changed), folder, "daily_sales", DEFAULT)
    assert sorted(rows(read())) == sorted(rows(daily.daily_sales(changed))) != want
