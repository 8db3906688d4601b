"""Stream vs batch: several out-of-order files with repeated orders, one
file per micro-batch, give the batch report's rows."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import SF001, make_shop, rows
from tillroll.plans.customers import customer_signups_daily
from tillroll.plans.daily import daily_sales
from tillroll.sources import star
from tillroll.streaming import daily as streams
from tillroll.streaming import log as log_module
from tillroll.streaming.log import UpsertLog


def _split(spark, table: str, parts: int, repeat_every: int) -> str:
    """Write ``table`` as ``parts`` files in shuffled order, with every
    ``repeat_every``-th row written a second time into another file."""
    src = star.read_table(spark, SF001, table)
    key = src.columns[0]
    folder = tempfile.mkdtemp(prefix=f"tillroll-stream-{table}-")
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    again = src.filter(F.col(key) % repeat_every == 0).withColumn("_b", F.pmod(bucket + 1, F.lit(parts)))
    every = src.withColumn("_b", bucket).unionByName(again)
    # each append adds one part-*.parquet file; arrival order is shuffled
    for b in sorted(range(parts), key=lambda i: (i * 7) % parts):
        every.filter(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.skipif(not os.path.isdir(SF001), reason="driver test data missing")
def test_daily_stream_equals_batch(spark):
    folder = _split(spark, "orders", 6, 10)
    paths = streams.run_daily_sales_stream(spark, folder, glob="part-*.parquet", max_files=1)
    got = sorted(rows(streams.read_daily_sales(spark, paths)))
    want = sorted(rows(daily_sales(star.load_shop(spark, SF001))))
    assert got == want and len(got) == 31
    # a second run over the same files adds nothing (checkpointed offsets)
    streams.run_daily_sales_stream(spark, folder, paths=paths, glob="part-*.parquet", max_files=1)
    assert sorted(rows(streams.read_daily_sales(spark, paths))) == want


@pytest.mark.skipif(not os.path.isdir(SF001), reason="driver test data missing")
def test_signups_stream_equals_batch(spark):
    folder = _split(spark, "events", 4, 7)
    paths = streams.run_signups_stream(spark, folder, glob="part-*.parquet", max_files=1)
    got = sorted(rows(streams.read_signups(spark, paths)))
    want = sorted(rows(customer_signups_daily(star.load_shop(spark, SF001))))
    assert got == want and len(got) == 30


# -- corrections, null ids, compaction ------------------------------------------------

def _order_rows(spark, rows):
    """Raw order rows (key, status, date, total, customer)."""
    return spark.createDataFrame(
        [(k, s, dt.datetime.fromisoformat(d) if d else None, t, c, "1-URGENT") for k, s, d, t, c in rows],
        "o_orderkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_totalprice decimal(15,2), o_custkey long, "
        "o_orderpriority string")


def _add_file(spark, folder, rows):
    time.sleep(0.05)  # files are versions: their times must differ
    _order_rows(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def _batch(spark, newest):
    """The batch report over the newest row of each order."""
    core = star.order_core(_order_rows(spark, newest))
    zero = F.lit(0).cast("decimal(18,4)")
    return sorted(rows(daily_sales(make_shop(spark).with_(orders=core.withColumns(
        {c: zero for c in ("order_tax", "order_discount", "cart_discount")})))))


FIRST = [(10, "F", "1998-03-05", Decimal(100), 1), (11, "F", "1998-03-05", Decimal(50), 2), (12, "O", "1998-03-06", Decimal(30), 3),
         (13, "F", "1998-02-01", Decimal(70), 3), (14, "F", "1998-03-09", None, 3), (15, "F", "1998-03-20", Decimal(5), 3)]
CHANGES = [
    [(10, "F", "1998-03-05", Decimal(80), 1)],                                             # another total
    [(11, "P", "1998-03-05", Decimal(50), 2), (12, "F", "1998-03-06", Decimal(31), 3)],    # leaves and enters by status
    [(13, "F", "1998-03-31", Decimal(70), 3), (15, "F", "1998-04-02", Decimal(5), 3)],     # enters and leaves by date
    [(10, "F", "1998-03-07", Decimal(80), 1), (14, "F", "1998-03-09", Decimal(1), 3)],     # moves to another day; gets a total
    [(11, "F", "1998-03-05", Decimal(50), 2), (10, None, "1998-03-07", Decimal(80), 1)],   # comes back; loses its status
]


@pytest.mark.parametrize("compact_every", [1, 50])
def test_corrected_orders_equal_the_batch_report(spark, compact_every):
    folder = tempfile.mkdtemp(prefix="tillroll-stream-orders-")
    newest, paths = {}, None
    for change in [FIRST, *CHANGES]:
        _add_file(spark, folder, change)
        newest |= {r[0]: r for r in change}
        paths = streams.run_daily_sales_stream(spark, folder, paths=paths, glob="part-*.parquet", max_files=1, compact_every=compact_every)
        assert sorted(rows(streams.read_daily_sales(spark, paths))) == _batch(spark, list(newest.values()))
    # all files in one batch give the same
    again = streams.run_daily_sales_stream(spark, folder, glob="part-*.parquet")
    assert sorted(rows(streams.read_daily_sales(spark, again))) == _batch(spark, list(newest.values()))


def test_signups_without_id_each_count(spark):
    folder = tempfile.mkdtemp(prefix="tillroll-stream-events-")
    moment = dt.datetime(2024, 1, 5, 10)
    later = dt.datetime(2024, 2, 20, 10)  # after the report's moment: no upper bound
    for part in ([(1, moment), (None, moment), (None, moment)], [(1, moment), (None, moment), (2, later)]):
        spark.createDataFrame([(i, 7, t, "signup", 0.0, "") for i, t in part],
                              "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"
                              ).coalesce(1).write.mode("append").parquet(folder)
    paths = streams.run_signups_stream(spark, folder, glob="part-*.parquet", max_files=1, compact_every=1)
    got = sorted(rows(streams.read_signups(spark, paths)))
    want = sorted(rows(customer_signups_daily(make_shop(spark).with_(signups=star.signup_dim(spark.read.parquet(folder))))))
    counts = {day: n for day, n in got if n}
    assert got == want and counts == {dt.date(2024, 1, 5): 4, dt.date(2024, 2, 20): 1}


def _log(spark, every):
    schema = StructType().add("k", "long").add("v", "long")
    log = UpsertLog(spark, tempfile.mkdtemp(prefix="tillroll-log-"), "k", schema, keep="v IS NOT NULL",
                    derived={"total": lambda r: r.agg(F.sum("v").alias("v"))}, every=every)
    log.start()
    return log, lambda pairs: spark.createDataFrame(pairs, schema).coalesce(1)


def test_many_batches_lie_in_few_files(spark):
    log, frame = _log(spark, 10)
    want, most = {}, 0
    for b in range(60):
        pairs = [(b % 7, b), (100 + b, 1), (100 + b // 2, None)]
        pairs = list(dict(pairs).items())
        log.append(frame(pairs), b)
        want |= dict(pairs)
        most = max(most, len(os.listdir(f"{log.folder}/log")))
    assert dict(rows(log.rows())) == {k: v for k, v in want.items() if v is not None}
    assert most <= 2 * 10 + 2 and len(os.listdir(f"{log.folder}/snapshots")) <= 2
    upto, folder = log.snapshot()
    assert log.stored(folder, "total").first()[0] == sum(r[1] for r in rows(log.stored(folder)))


def test_crash_before_the_pointer_and_repeated_batches_lose_nothing(spark, monkeypatch):
    log, frame = _log(spark, 3)
    for b in range(5):
        log.append(frame([(b, b)]), b)
    before = sorted(rows(log.rows()))

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(log_module, "publish", crash)
        with pytest.raises(RuntimeError):
            log.compact(4)
    assert sorted(rows(log.rows())) == before == [(b, b) for b in range(5)]
    log.append(frame([(5, 5), (0, None)]), 5)   # compacts; the folder without a pointer goes later
    log.append(frame([(5, 5), (0, None)]), 5)   # the batch runs again
    assert sorted(rows(log.rows())) == [(b, b) for b in range(1, 6)]
    for b in range(6, 13):
        log.append(frame([(b, b)]), b)
    assert sorted(rows(log.rows())) == [(b, b) for b in range(1, 13)]
    assert len(os.listdir(f"{log.folder}/snapshots")) <= 2
