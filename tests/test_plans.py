"""Plan shape guards: what must hold for the queries to scale."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF0001
from tillroll import catalog

QUERIES = {k: E.queries()[k] for k in catalog.queries()}
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_pair_joins_and_no_python_in_plan(spark, key):
    plan = _plan(QUERIES[key](spark, SF0001))
    assert not [f for f in FORBIDDEN if f in plan]


def test_range_report_prunes_items_and_orders(spark):
    plan = _plan(QUERIES["top_sellers"](spark, SF0001))
    assert "PartitionFilters: [isnotnull(item_type" in plan and "= line_item)" in plan
    assert "GreaterThan(order_created,1998-03-01T00:00)" in plan
    assert "LessThan(order_created,1998-04-01T00:00)" in plan
    assert "EqualTo(order_status,wc-completed)" in plan


@pytest.mark.parametrize("key", ["totals_overview", "top_sellers", "coupons_most_used", "monthly_taxes_by_rate", "category_sales_monthly"])
def test_items_are_not_shuffled_to_look_up_their_orders(spark, key):
    plan = _plan(QUERIES[key](spark, SF0001))
    assert "hashpartitioning(order_id" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(QUERIES["daily_sales"](spark, SF0001))
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("customer_id" not in s and "shipping" not in s for s in schemas)


@pytest.mark.parametrize("key", ["eav_pivot_orders", "eav_pivot_items"])
def test_pivots_of_bucketed_tables_shuffle_nothing(spark, key):
    plan = _plan(QUERIES[key](spark, SF0001))
    assert "hashpartitioning" not in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("key", ["top_sellers", "top_earners", "coupons_most_used", "coupons_greatest_discount"])
def test_top_lists_are_lazy(spark, key):
    QUERIES[key](spark, SF0001)  # stores the model
    tracker, group = spark.sparkContext.statusTracker(), f"build-{key}"
    spark.sparkContext.setJobGroup(group, "")
    plan = _plan(QUERIES[key](spark, SF0001))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup(group)
    assert "item_type" in plan and "lookup-keys" not in plan
