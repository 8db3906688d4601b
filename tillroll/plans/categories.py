"""Report 12: sales by category tree per month, month totals, stats.

The chosen categories are widened with all their descendants.  A category's
month figure is the sum of that month's line totals of the distinct
products in it or below it (a product counts once per category).  Only the
matrix months are used (months up to now's month in the current year).
Month totals add up only categories with no included ancestor, so a parent
and its child are not both counted (siblings still can be).  Categories
whose total is 0 have no row, but were still added to the month totals.

Plan: line totals are first reduced to (month, product) — at most 12 rows
per product, so a hot product cannot skew the later join — then joined to
the (category, product) bridge and grouped once by category into twelve
month sums; matrix rows, row totals and month totals are all read from
that one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.dates import in_year, matrix_months, month_of
from ..model import DEFAULT, Params, Shop
from ..operators.stats import entity_stats
from ..operators.taxonomy import (expand_with_descendants, materialized_closure, members,
                                  without_included_ancestor)
from .common import items_of_orders, month_sums, shop_order


def chosen_categories(shop: Shop, params: Params) -> DataFrame:
    return shop.categories.filter(F.col("name").isin(list(params.category_names))).select("term_id")


def _month_product_sales(shop: Shop, params: Params, hooks) -> DataFrame:
    shown = matrix_months(params.year, params.now)
    lines = items_of_orders(shop, "line_item", shop_order() & in_year(F.col("created"), params.year),
                            ["order_id", "product_id", "line_total"], month=month_of(F.col("created")))
    lines = lines.filter(F.col("product_id").isNotNull() & F.col("line_total").isNotNull())
    lines = H.apply(hooks, "categories.items", lines, year=params.year)
    return (lines.filter(F.col("month") <= shown)
            .groupBy("month", "product_id").agg(F.sum("line_total").alias("sales")))


def _category_rows(shop: Shop, params: Params, hooks):
    """(tree, included, rows): rows has one row per included category with
    sales — m1..m<shown> (that month's sales, null when none) and the total
    over the shown months — from ONE grouped aggregation over the
    (category, product) bridge joined to the (month, product) sales."""
    tree = materialized_closure(shop.categories)
    included = expand_with_descendants(chosen_categories(shop, params), tree)
    bridge = members(included, tree, shop.product_categories)
    sales = _month_product_sales(shop, params, hooks)
    shown = matrix_months(params.year, params.now)
    rows = bridge.join(sales, "product_id").groupBy("term_id").agg(
        *month_sums("sales", shown, "m"), F.sum("sales").alias("total"))
    return tree, included, rows


def _stack_months(shown: int) -> str:
    pairs = ", ".join(f"{m}, coalesce(m{m}, 0)" for m in range(1, shown + 1))
    return f"stack({shown}, {pairs}) AS (month, sales)"


def category_sales_monthly(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(category, is_child, month, sales): one row per kept category and matrix
    month (0 when no sales) plus its row total (month null), by name and month."""
    _, included, rows = _category_rows(shop, params, hooks)
    shown = matrix_months(params.year, params.now)
    cats = shop.categories.join(included, "term_id", "left_semi").select(
        "term_id", F.col("name").alias("category"), (F.col("parent_id") > 0).alias("is_child"))
    kept = cats.join(rows.filter(F.col("total") != 0), "term_id")
    dense = kept.selectExpr("category", "is_child", _stack_months(shown))
    row_totals = kept.select("category", "is_child", F.lit(None).cast("int").alias("month"),
                             F.col("total").alias("sales"))
    out = dense.unionByName(row_totals)
    return out.select("category", "is_child", F.col("month").cast("int"), F.col("sales").cast("double")).orderBy(
        "category", F.col("month").asc_nulls_last())


def category_sales_totals(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(month, sales): per matrix month the sum over categories without an
    included ancestor, plus the grand total (month null)."""
    tree, included, rows = _category_rows(shop, params, hooks)
    shown = matrix_months(params.year, params.now)
    tops = without_included_ancestor(included, tree)
    cols = rows.join(tops, "term_id", "left_semi").agg(*[F.expr(f"sum(m{m}) AS m{m}") for m in range(1, shown + 1)])
    months = cols.selectExpr(_stack_months(shown))
    grand = cols.selectExpr("CAST(NULL AS INT) AS month",
                            " + ".join(f"coalesce(m{m}, 0)" for m in range(1, shown + 1)) + " AS sales")
    out = months.unionByName(grand)
    return out.select(F.col("month").cast("int"), F.col("sales").cast("double"))


def category_sales_stats(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(top, top_total, worst, worst_total, average, median) over the kept
    categories in name order (first name wins ties).  Worst, average and
    median are shown only when more than one category is kept."""
    _, _, rows = _category_rows(shop, params, hooks)
    totals = rows.filter(F.col("total") != 0).select("term_id", "total")
    named = shop.categories.select("term_id", "name").join(totals, "term_id")
    s = entity_stats(named, "name", "total", F.col("name"), null_median_when_two=False)
    many = F.col("n") > 1
    return s.select("top", "top_total",
                    *[F.when(many, F.col(c)).alias(c) for c in ("worst", "worst_total", "average", "median")])


def category_closure(shop: Shop) -> DataFrame:
    """(ancestor, ancestor_id, term, term_id, depth) over the whole tree."""
    tree = materialized_closure(shop.categories)
    names = shop.categories.select("term_id", "name")
    return (tree.join(names.select(F.col("term_id").alias("ancestor_id"), F.col("name").alias("ancestor")),
                      "ancestor_id")
            .join(names.select("term_id", F.col("name").alias("term")), "term_id")
            .select("ancestor", "ancestor_id", "term", "term_id", F.col("depth").cast("int")))


def sales_rollup(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """Year line-item sales by (root category, month) with row, column and
    grand totals: (category, month, sales, level) where level is the
    grouping id (0 cell, 1 category total, 2 month total, 3 grand total).

    A product belongs to the root above its terms at any depth, also when it
    is a member of the root itself, and counts once per root: under two roots
    it is in both and twice in the totals over roots.  Products without a term
    are in no cell and no total."""
    lines = items_of_orders(shop, "line_item", shop_order() & in_year(F.col("created"), params.year),
                            ["order_id", "product_id", "line_total"], month=month_of(F.col("created")))
    lines = lines.filter(F.col("product_id").isNotNull() & F.col("line_total").isNotNull())
    per = lines.groupBy("month", "product_id").agg(F.sum("line_total").alias("sales"))
    roots = shop.categories.filter(F.coalesce("parent_id", F.lit(0)) == 0).select("term_id", F.col("name").alias("category"))
    product_root = members(roots.select("term_id"), materialized_closure(shop.categories), shop.product_categories)
    cells = per.join(product_root, "product_id").join(roots, "term_id")
    cube = cells.cube("category", "month").agg(F.sum("sales").alias("sales"),
                                               F.grouping_id().alias("level"))
    return cube.select("category", F.col("month").cast("int"), F.col("sales").cast("double"),
                       F.col("level").cast("int"))
