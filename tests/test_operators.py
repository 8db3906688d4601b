"""Operators against brute force on small generated frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators.running import max_running_sum
from tillroll.operators.stats import entity_stats, global_rank
from tillroll.operators import taxonomy
from tillroll.operators.taxonomy import closure
from tillroll.session import write_table


def test_global_rank_equals_full_sort_with_a_hot_value(spark):
    # a third of the rows share one value; the tie key keeps the order unique
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 1001).cast("double")).alias("v"),
        F.format_string("e%05d", F.col("id")).alias("tie"))
    got = {r["tie"]: (r["_rn"], r["_n"]) for r in global_rank(df, ["v", "tie"], 5).collect()}
    want = {r["tie"]: r["rn"] for r in df.select(
        "tie", F.row_number().over(Window.orderBy("v", "tie")).alias("rn")).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert {v[1] for v in got.values()} == {3000}


def test_global_rank_empty(spark):
    df = spark.range(0).select(F.col("id").cast("double").alias("v"), F.col("id").cast("string").alias("tie"))
    assert global_rank(df, ["v", "tie"], 4).count() == 0


def test_max_running_sum_equals_brute_force(spark):
    base = dt.datetime(1998, 1, 1)
    rows = [(i, base + dt.timedelta(hours=(i * 7) % 700), float((i * 13) % 11 - 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "order_id long, created timestamp_ntz, qty double").withColumn(
        "month", F.date_format("created", "yyyyMM"))
    got = {r["month"]: (r["qty_sum"], r["qty_max_run"]) for r in max_running_sum(
        df, ["month"], ["created", "order_id"], ["qty"], F.date_trunc("hour", F.col("created"))).collect()}
    want = {}
    for month in sorted({r[1].strftime("%Y%m") for r in rows}):
        run, best = 0.0, None
        for oid, created, qty in sorted((r for r in rows if r[1].strftime("%Y%m") == month), key=lambda r: (r[1], r[0])):
            run += qty
            best = run if best is None else max(best, run)
        want[month] = (run, best)
    assert got == want


@pytest.mark.parametrize("partitions", [8, 32])
def test_ranks_of_600_000_rows(spark, partitions):
    """More rows than the range sampler looks at: ranks must still be 1..n in
    order, and the house median that of a sort."""
    n = 600_000
    df = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"),
                               F.pmod(F.xxhash64("id"), F.lit(10 ** 6)).cast("decimal(18,4)").alias("total"))
    ranked = global_rank(df, ["total", "name"], partitions)
    got = ranked.agg(F.min("_rn"), F.max("_rn"), F.countDistinct("_rn"), F.max("_n")).first()
    assert tuple(got) == (1, n, n, n)
    values = sorted(float(r[0]) for r in df.select("total").toLocalIterator())
    s = entity_stats(df, "name", "total", F.col("name"), False).first()
    assert s["median"] == values[n // 2] and s["n"] == n


@pytest.mark.parametrize("spread", ["ties", "one value", "skew", "odd"])
def test_median_of_a_million_totals(spark, spread):
    n = 1_000_001 if spread == "odd" else 1_000_000
    h = F.pmod(F.xxhash64("id"), F.lit(10 ** 6))
    value = {"ties": F.floor(h / 1000), "one value": F.when(F.col("id") % 3 == 0, h).otherwise(7), "skew": F.exp(h / 50_000),
             "odd": h - 500_000}[spread]
    df = spark.range(n).select(F.col("id").cast("string").alias("name"), value.cast("decimal(18,4)").alias("total"))
    df = df.withColumn("total", F.when(F.col("name") != "5", F.col("total")))  # one total is unknown: it ranks first
    values = sorted((r[0] for r in df.filter("total IS NOT NULL").select("total").toLocalIterator()))
    at = lambda r: float(values[r - 1 - 1])  # noqa: E731  ranks count the unknown one
    want = (at(n // 2 + 1) + at(n // 2 + 2)) / 2 if n % 2 else at(n // 2 + 1)
    stats = entity_stats(df, "name", "total", F.col("name"), False)
    assert "rangepartitioning" not in stats._jdf.queryExecution().executedPlan().toString()
    got = stats.first()
    assert got["median"] == want and got["n"] == n


def test_statistics_are_lazy_and_empty_ones_null(spark):
    got = entity_stats(spark.createDataFrame([], "name string, total decimal(18,4)"), "name", "total", F.col("name"), True).first()
    assert tuple(got) == (0, None, None, None, None, None, None)


def test_ranks_come_from_one_range_exchange(spark):
    df = spark.range(1000).select(F.col("id").alias("v"))
    plan = global_rank(df, ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the ranges are a written table


def test_closure_of_many_terms_and_of_a_cycle(spark):
    wide = spark.range(1, 1_200_001).select(F.col("id").alias("term_id"), F.when(F.col("id") <= 1000, 0).otherwise(F.col("id") % 1000 + 1).cast("bigint").alias("parent_id"))
    assert closure(wide).groupBy("depth").count().orderBy("depth").collect() == [(0, 1_200_000), (1, 1_199_000)]
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 0)], "term_id long, parent_id long")
    two = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (4, 1), (5, 4), (6, 6), (None, 1)], "term_id long, parent_id long")
    assert sorted(tuple(r) for r in closure(two).filter("ancestor_id = 1 OR term_id = 6").collect()) == [
        (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 2), (6, 6, 0)]
    assert sorted(tuple(r) for r in closure(ring).collect()) == [
        (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 2, 0), (2, 3, 1), (3, 3, 0), (4, 4, 0)]



def test_closure_of_a_deep_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(taxonomy, "write_table", lambda df, name: rounds.append(name) or write_table(df, name))
    n = 2_000
    chain = spark.range(1, n + 1).select(F.col("id").alias("term_id"), (F.col("id") - 1).alias("parent_id"))
    got = closure(chain).agg(F.count(F.lit(1)), F.max("depth"), F.sum("depth"), F.sum(F.abs(F.col("term_id") - F.col("ancestor_id") - F.col("depth")))).first()
    assert tuple(got) == (n * (n + 1) // 2, n - 1, (n - 1) * n * (n + 1) // 6, 0)
    assert len(rounds) <= 13


def test_max_running_sum_rank_slices_equal_brute_force(spark):
    base = dt.datetime(1998, 1, 1)
    rows = [(i, base + dt.timedelta(hours=(i * 7) % 700), float((i * 13) % 11 - 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "order_id long, created timestamp_ntz, qty double").withColumn(
        "month", F.date_format("created", "yyyyMM"))
    hours = {r["month"]: (r["qty_sum"], r["qty_max_run"]) for r in max_running_sum(
        df, ["month"], ["created", "order_id"], ["qty"], F.date_trunc("hour", F.col("created"))).collect()}
    slices = {r["month"]: (r["qty_sum"], r["qty_max_run"]) for r in max_running_sum(
        df, ["month"], ["created", "order_id"], ["qty"], partitions=7).collect()}
    assert slices == hours
