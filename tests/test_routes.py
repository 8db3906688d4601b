"""The raw EAV export route and the typed star route give the same reports."""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from dataclasses import replace

import pytest

from conftest import SF0001
from tillroll.model import DEFAULT
from tillroll.plans import categories, coupons, customers, daily, monthly, products, stock, taxes, totals
from tillroll.sources import eav, star

REPORTS = {
    "totals": lambda s: totals.totals_overview(s),
    "daily": lambda s: daily.daily_sales(s),
    "daily_summary": lambda s: daily.daily_sales_summary(s),
    "monthly": lambda s: monthly.monthly_sales(s),
    "top_sellers": lambda s: products.top_sellers(s).drop("product_id", "title"),
    # the export has its own product ids: choose the same products
    "product_history": lambda s, ids=DEFAULT.products: products.product_sales_monthly(s, replace(DEFAULT, products=tuple(ids))),
    "coupon_overview": lambda s: coupons.coupon_usage_overview(s),
    "coupons_most_used": lambda s: coupons.coupons_most_used(s).drop("coupon_id"),
    "coupon_matrix": lambda s: coupons.coupon_discounts_monthly(s),
    "customers": lambda s: customers.customer_guest_overview(s),
    "signups": lambda s: customers.customer_signups_daily(s),
    "low_stock": lambda s: stock.low_stock(s).select("stock", "sku", "title"),
    "out_of_stock": lambda s: stock.out_of_stock(s).select("stock", "marked", "sku", "title"),
    "taxes": lambda s: taxes.monthly_taxes(s),
    "taxes_by_rate": lambda s: taxes.monthly_taxes_by_rate(s),
    "category_monthly": lambda s: categories.category_sales_monthly(s),
}


@pytest.fixture(scope="module")
def both(spark):
    folder = tempfile.mkdtemp(prefix="tillroll-raw-")
    eav.write_raw(eav.star_to_raw(spark, SF0001), folder)
    _FOLDERS["raw"] = folder
    return star.load_shop(spark, SF0001), eav.raw_to_shop(eav.read_raw(spark, folder))


_FOLDERS: dict[str, str] = {}


def _folder(_both) -> str:
    return _FOLDERS["raw"]


def _bag(df):
    cols = sorted(df.columns)
    return Counter(tuple(float(f"{r[c]:.9g}") if isinstance(r[c], float) and not math.isnan(r[c]) else r[c]
                         for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_raw_route_equals_typed_route(both, name):
    typed, raw = both
    report = REPORTS[name]
    ids = [eav.post_id(p, eav.PRODUCT_KIND) for p in DEFAULT.products]
    raw_df = report(raw, ids) if name == "product_history" else report(raw)
    want = _bag(report(typed))
    assert want and _bag(raw_df) == want


def test_raw_export_has_no_column_per_measure(spark, both):
    # the export really is key/value: every order measure is a text row
    raw = eav.star_to_raw(spark, SF0001)
    keys = {r[0] for r in raw.postmeta.select("meta_key").distinct().collect()}
    assert set(eav.ORDER_KEYS) <= keys
    assert dict(raw.postmeta.dtypes)["meta_value"] == "string"


def test_fanout_without_order_terms_changes_nothing(spark, both):
    # the export links only products to terms, so repeating orders per term
    # row of the order must leave every order once
    typed, _ = both
    raw = eav.read_raw(spark, _folder(both))
    fanned = eav.raw_to_shop(raw, fanout=True)
    assert fanned.fanout
    assert _bag(totals.totals_overview(fanned)) == _bag(totals.totals_overview(typed))


def test_one_pass_items_equal_union_items(spark):
    lineitem = star.read_table(spark, SF0001, "lineitem")
    assert _bag(star.item_rows_one_pass(lineitem)) == _bag(star.item_fact(lineitem))


def test_csv_export_route_equals_typed_route(spark, both):
    typed, _ = both
    folder = tempfile.mkdtemp(prefix="tillroll-csv-")
    eav.write_raw(eav.star_to_raw(spark, SF0001), folder, fmt="csv")
    csv_shop = eav.raw_to_shop(eav.read_raw(spark, folder, fmt="csv"))
    for name in ("totals", "daily", "low_stock", "out_of_stock", "customers", "taxes"):
        assert _bag(REPORTS[name](csv_shop)) == _bag(REPORTS[name](typed)), name
