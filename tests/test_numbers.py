"""Scalar helpers: MySQL text coercion (M2), PHP integer rules, rounding."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions.numbers import (absint, mysql_number, mysql_signed, php_int, round2_percent,
                                        round2_ratio, share_of_max)


@pytest.mark.parametrize("text, expected", [
    ("12.50", 12.5), ("", 0.0), ("abc", 0.0), ("3x", 3.0), (" 7", 7.0),
    ("-2.5e1z", -25.0), (".5", 0.5), (None, None), ("+4", 4.0), ("1e", 1.0),
])
def test_m2_mysql_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mysql_number("t").alias("n")).first()["n"] == expected


@pytest.mark.parametrize("text, expected", [("3", 3), ("0.5", 0), ("-2x", -2), ("", 0), ("abc", 0), (None, None)])
def test_mysql_signed(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mysql_signed("t").alias("n")).first()["n"] == expected


@pytest.mark.parametrize("x, expected", [(2.9, 2), (-2.9, 2), (-1.0, 1), (0.0, 0), (None, 0)])
def test_absint(spark, x, expected):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(absint("x").alias("n")).first()["n"] == expected


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.5,)], "x double")
    assert [r[0] for r in df.select(F.round("x", 0)).collect()] == [3.0, -3.0, 1.0]


@pytest.mark.parametrize("num, den, ratio, pct", [(3, 4, 0.75, 75.0), (1, 3, 0.33, 33.33),
                                                  (2, 3, 0.67, 66.67), (1, 8, 0.13, 12.5)])
def test_two_decimal_ratios(spark, num, den, ratio, pct):
    df = spark.createDataFrame([(num, den)], "n long, d long")
    r = df.select(round2_ratio("n", "d").alias("r"), round2_percent("n", "d").alias("p")).first()
    assert (r["r"], r["p"]) == (ratio, pct)


def test_share_of_max(spark):
    df = spark.createDataFrame([(5.0, 10.0), (-1.0, 10.0), (0.4, 0.4)], "v double, m double")
    plain = [r[0] for r in df.select(share_of_max("v", "m")).collect()]
    rounded = [r[0] for r in df.select(share_of_max("v", "m", rounded=True)).collect()]
    assert plain == [50.0, 0.0, 100.0]
    assert rounded == [50.0, 0.0, None]  # round(0.4) = 0: no division by zero


@pytest.mark.parametrize("dtype", ["decimal(18,4)", "bigint"])
@pytest.mark.parametrize("text", ["12.50", "5.", ".5", "+4", "-2.5e1z", "1-2", "1e3", "7 ", " 7", "0x1p3", "3.7",
                                  "١٢", "\x015", "3.14159", "-0", "e5", "1.5d", "", "abc"])
def test_cast_fast_path_equals_prefix_rule(spark, dtype, text):
    from tillroll.functions.numbers import NUMERIC_PREFIX
    df = spark.createDataFrame([(text,)], "t string")
    slow = F.coalesce(F.regexp_extract("t", NUMERIC_PREFIX, 1).try_cast("decimal(38,4)"), F.lit(0)).cast(dtype)
    r = df.select(mysql_number("t", dtype).alias("fast"), slow.alias("slow")).first()
    assert r["fast"] == r["slow"]


def test_large_numbers_are_kept_or_bounded_never_zero(spark):
    df = spark.createDataFrame([("100000000000000.5",)], "t string")
    assert df.select(mysql_number("t", "decimal(28,4)").alias("n")).first()["n"] == 100000000000000.5
    for dtype, bound in (("decimal(18,4)", Decimal("99999999999999.9999")), ("bigint", (1 << 63) - 1)):
        big = spark.createDataFrame([("1" * 25,)], "t string")
        assert big.select(mysql_number("t", dtype)).first()[0] == bound
    assert df.select(mysql_number("t", "decimal(18,4)")).first()[0] == Decimal("99999999999999.9999")


def test_integers_saturate(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    df = spark.createDataFrame([("9" * 20, 1e30), ("-" + "9" * 20, -1e30), ("12x", -3.9)], "t string, x double")
    got = [tuple(r) for r in df.select(mysql_signed("t"), php_int("x"), absint("x")).collect()]
    assert got == [(top, top, top), (low, low, top), (12, -3, 3)]



def test_display_text(spark):
    import datetime as dt
    from tillroll.functions.dates import day_text, month_label
    from tillroll.functions.numbers import money_text, number_text
    df = spark.createDataFrame([(1234.5, dt.date(1998, 3, 7))], "x double, d date")
    r = df.select(number_text("x").alias("n"), money_text("x", "$").alias("m"),
                  month_label(F.col("d")).alias("s"), month_label(F.col("d"), full=True).alias("l"),
                  day_text(F.col("d")).alias("t")).first()
    assert (r["n"], r["m"], r["s"], r["l"], r["t"]) == ("1,234.50", "$1,234.50", "Mar", "March", "1998-03-07")
