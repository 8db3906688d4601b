"""Incremental (Structured Streaming) forms of the scheduled reports.

The original recomputes the daily report from scratch on a schedule.  Here
new order files are picked up incrementally:

    file source -> typed projection
      -> newest version per order   (state: an order's day and amount, or that
                                     it does not count)
      -> update mode -> foreachBatch upsert log by order

The original recomputes from scratch, so an order that was counted and later
changes its total, status or date, or is refunded, must leave its old day.  A
change is a new row of the order in a later file: the state keeps the newest,
by the file's time, its name and the row's place in it, whatever order the
files are read in.  The reader takes the day totals of the log's snapshot and
applies the differences of the orders changed since: minus what the
snapshot has of them, plus what they are now.

Late data: there is no watermark, a row counts however late it comes.  The state
has one small row per order, also of those outside the range, since an order may
move into it.  Sign-ups don't change: their stream de-duplicates event ids
(events without one each count) and counts per day.

A table is one file, several, or a folder of part files: the source is a
path pattern, read through Spark's own file systems.  The sink starts with an
empty batch of the result's schema, so a stream that has seen no row reads as
an empty one wherever the sink lies.

The sink is an ``UpsertLog`` in the shared checkpoint folder, compacted into
snapshots (see ``log.py``); readers gap-fill the report calendar.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import after_start_before_end_day
from ..functions.numbers import MONEY
from ..model import COMPLETED, DEFAULT, SHOP_ORDER, Params
from ..operators.calendar import day_spine, gap_fill, report_day_spine
from ..plans.customers import in_signup_window, signup_window
from ..session import scratch_path
from ..sources.star import order_core
from .log import COMPACT_EVERY, UpsertLog

ORDER_ROWS = StructType().add("order_id", "long").add("day", "date").add("amount", "decimal(18,4)")
DAY_ROWS = StructType().add("day", "date").add("signups", "long")


@dataclass(frozen=True)
class StreamPaths:
    checkpoint: str
    sink: str


def new_paths(spark: SparkSession, name: str) -> StreamPaths:
    base = scratch_path(spark, name)
    return StreamPaths(os.path.join(base, "checkpoint"), os.path.join(base, "sink"))


def _file_stream(spark: SparkSession, source_dir: str, glob: str, max_files: int | None) -> DataFrame:
    # the pattern matches files and folders of part files alike; the schema
    # comes from the files' footers (no data is read here)
    if not any(c in glob for c in "*?[{"):
        glob = f"{glob[:-1]}[{glob[-1]}]"  # a plain name would have to be a folder
    pattern = f"{source_dir.rstrip('/')}/{glob}"
    reader = spark.readStream.schema(spark.read.parquet(pattern).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(pattern)


def _run(rows: DataFrame, paths: StreamPaths, log: UpsertLog, name: str, available_now: bool = True):
    log.start()
    writer = (rows.writeStream.queryName(f"{name}_{os.path.basename(os.path.dirname(paths.sink))}").outputMode("update")
              .option("checkpointLocation", paths.checkpoint).foreachBatch(log.append))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def _day_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("amount"))


def order_log(spark: SparkSession, paths: StreamPaths, every: int = COMPACT_EVERY) -> UpsertLog:
    """(order_id, day, amount) by order; a null day is an order that does not count."""
    return UpsertLog(spark, paths.sink, "order_id", ORDER_ROWS, keep="day IS NOT NULL", derived={"days": _day_totals}, every=every)


def signup_log(spark: SparkSession, paths: StreamPaths, every: int = COMPACT_EVERY) -> UpsertLog:
    return UpsertLog(spark, paths.sink, "day", DAY_ROWS, every=every)


def newest_orders(orders_stream: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The streaming plan over a file stream of raw driver order rows: the day and
    amount of each order's newest version, null if it does not count."""
    version = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index")
    o = order_core(orders_stream, version.alias("version"))
    counts = ((F.col("status") == COMPLETED) & (F.col("post_type") == SHOP_ORDER) & F.col("total").isNotNull()
              & after_start_before_end_day(F.col("created"), params.start, params.end))
    value = F.struct(F.when(counts, F.to_date("created")).alias("day"), F.when(counts, F.col("total")).alias("amount"))
    newest = o.groupBy("order_id").agg(F.max_by(value, "version").alias("v"))
    return newest.select("order_id", "v.day", F.col("v.amount").cast(MONEY).alias("amount"))


def run_daily_sales_stream(spark: SparkSession, source_dir: str, params: Params = DEFAULT,
                           paths: StreamPaths | None = None, glob: str = "orders*.parquet",
                           max_files: int | None = None, compact_every: int = COMPACT_EVERY) -> StreamPaths:
    paths = paths or new_paths(spark, "daily-sales-stream")
    rows = newest_orders(_file_stream(spark, source_dir, glob, max_files), params)
    _run(rows, paths, order_log(spark, paths, compact_every), "daily_sales")
    return paths


def read_daily_sales(spark: SparkSession, paths: StreamPaths, params: Params = DEFAULT) -> DataFrame:
    """(day, orders, amount) exactly as the batch daily report."""
    log = order_log(spark, paths)
    upto, folder = log.snapshot()
    changed = log.changes(upto)
    one = F.lit(1).cast("bigint")
    parts = changed.filter(log.keep).select("day", one.alias("orders"), F.col("amount"))
    if folder is not None:
        before = log.stored(folder).join(changed, "order_id", "left_semi")
        parts = (parts.unionByName(log.stored(folder, "days"))
                 .unionByName(before.select("day", (-one).alias("orders"), (-F.col("amount")).alias("amount"))))
    per_day = parts.groupBy("day").agg(F.sum("orders").alias("orders"), F.sum("amount").alias("amount")).filter("orders > 0")
    spine = report_day_spine(spark, params.start, params.end)
    out = gap_fill(spine, per_day, ["day"], {"orders": F.lit(0).cast("bigint"), "amount": F.lit(0)}, how="full")
    return out.select("day", F.col("orders").cast("bigint"), F.col("amount").cast("double")).orderBy("day")


def signups_aggregate(events_stream: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Sign-ups per day; like the batch report, an event counts once, and one
    without an id each time."""
    e = events_stream.filter((F.col("event_type") == "signup") & in_signup_window(F.col("ts"), params.signup_now))
    once = e.filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    every = once.union(e.filter(F.col("event_id").isNull()))
    return every.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("signups"))


def run_signups_stream(spark: SparkSession, source_dir: str, params: Params = DEFAULT,
                       paths: StreamPaths | None = None, glob: str = "events*.parquet",
                       max_files: int | None = None, compact_every: int = COMPACT_EVERY) -> StreamPaths:
    paths = paths or new_paths(spark, "signups-stream")
    agg = signups_aggregate(_file_stream(spark, source_dir, glob, max_files), params)
    _run(agg, paths, signup_log(spark, paths, compact_every), "signups")
    return paths


def read_signups(spark: SparkSession, paths: StreamPaths, params: Params = DEFAULT) -> DataFrame:
    _, first_day, days = signup_window(params.signup_now)
    spine = day_spine(spark, first_day, days)
    per_day = signup_log(spark, paths).rows()
    return gap_fill(spine, per_day, ["day"], {"signups": F.lit(0).cast("bigint")}, how="full").select(
        "day", F.col("signups").cast("bigint")).orderBy("day")
