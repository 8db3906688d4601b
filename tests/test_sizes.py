"""Storing the export and the model: in proportion to the input, only what a query reads,
and moving lines instead of their items."""

from __future__ import annotations

import os
import tempfile
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF0001, rows
from tillroll import catalog, session
from tillroll.operators.stats import global_rank
from tillroll.plans import operators_demo as ops
from tillroll.sources import eav, star, stored
from tillroll.session import drop_scratch


def _bag(df):
    return Counter(rows(df))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# F1

def test_partitions_follow_the_input(spark):
    folder = tempfile.mkdtemp(prefix="tillroll-size-")
    least = session.range_partitions(spark)
    for name, size in (("small", 1 << 10), ("large", session.PART_BYTES * (least + 3))):
        with open(os.path.join(folder, name), "wb") as f:
            f.truncate(size)
    assert session.data_partitions(spark, [f"{folder}/small"]) == least
    assert session.data_partitions(spark, [f"{folder}/small", f"{folder}/large"]) == least + 4
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(k) for k in keys]
    with session.sized(spark, 77):
        assert spark.conf.get(keys[0]) == "77" and spark.conf.get(keys[1]) == str(2 * session.PART_BYTES)
    with session.sized(spark, 1):  # never fewer than the session has
        assert spark.conf.get(keys[0]) == before[0]
    assert [spark.conf.get(k) for k in keys] == before


def test_ranks_need_no_second_move(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked = global_rank(df, ["v"], 5)
    assert "row_number" not in _plan(ranked)
    assert {(r["v"], r["_rn"]) for r in ranked.collect()} == {(i, i + 1) for i in range(1000)}
    some = spark.createDataFrame([(None,), (2,), (None,), (2,), (1,)], "v int")
    assert sorted((r["_rn"], r["v"]) for r in global_rank(some, ["v"], 3).collect()) == [(1, None), (2, None), (3, 1), (4, 2), (5, 2)]


def test_items_are_pivoted_and_joined_where_they_lie(spark):
    drop_scratch(spark)
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = E.queries()["eav_pivot_items"](spark, SF0001)
        plan = _plan(got)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = _bag(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
    # the same rows as from tables that are not stored
    plain = eav.raw_items(eav.star_to_raw(spark, SF0001)).withColumns({c: eav.source_key(F.col(c)) for c in ("order_id", "product_id")})
    assert want == _bag(plain.select("order_item_id", "order_id", "item_type", "item_name", "product_id",
                                     *[F.col(c).cast("double") for c in ops._ITEM_MONEY]))
    raw = eav.exported_raw(spark, SF0001)
    buckets = raw.order_items.groupBy(F.input_file_name().alias("f")).agg(F.countDistinct(eav.ID_RANGE).alias("n"))
    assert all(r["n"] == 1 for r in buckets.collect())  # a range has its own bucket
    assert raw.order_items.select(eav.ID_RANGE).distinct().count() == session.range_partitions(spark)
    E.queries()["totals_overview"](spark, SF0001)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


# F2 and F3

def test_lines_are_moved_and_unpacked_where_they_are_written(spark):
    lines = star.read_table(spark, SF0001, "lineitem")
    seen = []

    def unpack(df, keep):
        seen.append(df)
        return star.item_rows_one_pass(df, keep=keep)
    packed = lines.select(*star.ITEM_SOURCE).withColumn("order_id", F.col("l_orderkey"))
    shop = star.load_shop(spark, SF0001)
    model = stored.store_shop(shop, tempfile.mkdtemp(prefix="tillroll-packed-"), 5, lines=packed, unpack=unpack, measures=star.line_measures(lines))
    plain = stored.store_shop(shop, tempfile.mkdtemp(prefix="tillroll-plain-"), 5)
    assert model.items.columns == plain.items.columns and model.items.dtypes == plain.items.dtypes
    assert _bag(model.items) == _bag(plain.items)
    assert len(seen) == 1 and "slice" in seen[0].columns and seen[0].count() == lines.count()
    # each file holds one kind of one slice, in order
    placed = model.items.select(F.input_file_name().alias("f"), "order_created", F.monotonically_increasing_id().alias("at"))
    for r in placed.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("at", "order_created"))).alias("r")).collect():
        times = [x["order_created"] for x in r["r"]]
        assert times == sorted(times)


def test_the_catalog_sizes_the_model_by_its_files(spark, monkeypatch):
    drop_scratch(spark)
    monkeypatch.setattr(session, "PART_BYTES", 1 << 12)
    files = [f"{SF0001}/{name}.parquet" for name in star.TABLES]
    want = sum(os.path.getsize(f) for f in files) // (1 << 12)
    shop = catalog.shop(spark, SF0001)
    assert shop._partitions >= want > session.range_partitions(spark)
    drop_scratch(spark)


# F4

def test_a_query_stores_only_the_raw_tables_it_reads(spark):
    drop_scratch(spark)
    want = {"customer_semi_join": {"posts", "postmeta"}, "eav_repeated_keys": {"posts", "postmeta"},
            "eav_pivot_items": {"posts", "postmeta", "order_items", "order_itemmeta"}}
    for name, tables in want.items():
        E.queries()[name](spark, SF0001).count()
        raw = eav.exported_raw(spark, SF0001)
        assert set(raw.__dict__) & set(eav.RAW_TABLES) == tables, name


# F5

def test_signups_store_no_order(spark):
    drop_scratch(spark)
    E.queries()["chart_series_signups"](spark, SF0001).collect()
    assert catalog.shop(spark, SF0001)._manifest == {}


# F6

def test_measures_of_lines_are_those_of_their_items(spark):
    lines = star.read_table(spark, SF0001, "lineitem")
    odd = spark.createDataFrame([(7, 1, None, None, 0.1, None), (8, None, 2.0, 5.0, None, 0.1), (None, 1, 1.0, 1.0, 0.5, 0.0), (57, 1, 3.0, 9.99, 0.015, 0.0)],
                                "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    for df in (lines, odd.withColumn("l_returnflag", F.lit("N"))):
        assert _bag(star.line_measures(df)) == _bag(stored.order_measures(star.item_fact(df)))


# F3, F4 and F6 of the third round

def test_adaptive_execution_keeps_stored_partitions_small(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    with session.sized(spark, 1):
        assert spark.conf.get(key) == str(session.PART_BYTES)
    assert spark.conf.get(key) == before


def _odd_lines(spark):
    return spark.createDataFrame(
        [(7, 1, None, None, 0.1, None, "N"), (8, None, 2.0, 5.0, None, 0.1, None), (None, 1, 1.0, 1.0, 0.5, 0.02, "R"),
         (57, 1, 3.0, 9.99, 0.015, 0.0, "A"), (57, 1, 3.0, 9.99, 0.015, 0.0, "A"), (9, 2, 1.0, 100.0, 1e-9, -0.05, "A")],
        "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string")


def test_lines_unpack_to_the_items_of_the_three_projections(spark):
    lines = star.read_table(spark, SF0001, "lineitem")
    for df in (lines, _odd_lines(spark)):
        want = star.item_fact(df)
        got = star.items_of_lines(star.line_amounts(df))
        assert got.columns == want.columns and got.dtypes == want.dtypes and _bag(got) == _bag(want)
        assert _bag(star.item_rows_one_pass(df.withColumn("rn", F.lit(9)), item_id=F.col("rn") * 3)) == _bag(
            star.item_fact(df.withColumn("rn", F.lit(9)), item_id=F.col("rn") * 3))
    assert "struct" not in dict(star.line_amounts(lines).dtypes).values()


def test_orders_are_measured_by_one_aggregate(spark):
    orders, lines = (star.read_table(spark, SF0001, name) for name in ("orders", "lineitem"))
    for df in (lines, _odd_lines(spark)):
        got = star.measured_orders(orders, df)
        want = star.order_fact(orders, df).join(stored.order_measures(star.item_fact(df)), "order_id", "left")
        assert got.columns == want.columns and got.dtypes == want.dtypes and _bag(got) == _bag(want)
    assert _plan(star.measured_orders(orders, lines)).count("lineitem.parquet") == 1
    drop_scratch(spark)
    assert catalog.shop(spark, SF0001)._measured is not None


def test_orders_are_dealt_before_their_meta_rows_are_made(spark):
    raw = eav.star_to_raw(spark, SF0001)
    dealt = raw.dealt["postmeta"](5)
    assert _bag(dealt) == _bag(raw.postmeta)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate stack") < plan.index("RepartitionByExpression [order_id")
    here = dealt.select("post_id", F.spark_partition_id().alias("p")).distinct().groupBy("post_id").count()
    assert here.filter("count > 1").count() == 0  # an entity's rows lie together
    assert "postmeta" not in raw.with_tables(postmeta=dealt).dealt
