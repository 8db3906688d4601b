"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver tables of ``sf_dir`` through the star loader
and runs one report or operator over the whole tables with the fixed
parameters of ``tillroll.model.DEFAULT``.  The oracle text computes the same
columns (same names, same types) from the same parquet views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import DEFAULT
from .oracle import with_model
from .session import data_partitions, fingerprint, registry, scratch_path
from .sources.star import TABLES, coupon_dim, items_of_lines, line_amounts, load_shop, measured_orders, read_table
from .sources.stored import store_shop

P = DEFAULT
START, END = P.start.isoformat(), P.end.isoformat()
END_NEXT = "1998-04-01"
YEAR = P.year
NOW = P.now.strftime("%Y-%m-%d %H:%M:%S")

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        _REGISTRY[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_reports  # noqa: F401  (registers the entries)
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    from . import catalog_reports  # noqa: F401
    return dict(_ORACLE)


_SHOPS: dict[tuple[str, str], tuple[str, object]] = registry()


def shop(spark: SparkSession, sf_dir: str):
    """The typed model of ``sf_dir``: mapped from the driver tables, each frame
    stored in the shared checkpoint folder when a report of the session first
    reads it (see ``StoredShop``), as the original's reports query the shop
    database.  When the tables' files have changed since, it is mapped anew."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    files = [f"{key[1]}/{name}.parquet" for name in TABLES]
    now = fingerprint(spark, files)
    if key not in _SHOPS or _SHOPS[key][0] != now:
        lines = read_table(spark, sf_dir, "lineitem")
        # lines are moved, not their items, of which each has up to three
        measured = measured_orders(read_table(spark, sf_dir, "orders"), lines)
        _SHOPS[key] = now, store_shop(load_shop(spark, sf_dir), scratch_path(spark, "shop"), data_partitions(spark, files),
                                      coupons=coupon_dim, lines=line_amounts(lines), unpack=items_of_lines, measured=measured)
    return _SHOPS[key][1]


# -- oracle fragments shared by several queries ------------------------------

COMPLETED_ORDERS = "status = 'wc-completed' AND post_type = 'shop_order'"
IN_RANGE = f"created > TIMESTAMP '{START} 00:00:00' AND created < TIMESTAMP '{END_NEXT} 00:00:00'"
IN_YEAR = f"created >= TIMESTAMP '{YEAR}-01-01 00:00:00' AND created < TIMESTAMP '{YEAR + 1}-01-01 00:00:00'"


def round2_sql(num: str, den: str) -> str:
    return (f"CAST(CAST(floor((CAST({num} AS BIGINT) * 200 + CAST({den} AS BIGINT)) / "
            f"(CAST({den} AS BIGINT) * 2)) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE)")


def pct2_sql(num: str, den: str) -> str:
    return (f"CAST(CAST(floor((CAST({num} AS BIGINT) * 20000 + CAST({den} AS BIGINT)) / "
            f"(CAST({den} AS BIGINT) * 2)) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE)")


def absint_sql(x: str) -> str:
    return f"COALESCE(abs(CAST(trunc({x}) AS BIGINT)), CAST(0 AS BIGINT))"


__all__ = ["queries", "oracle_sql", "register", "with_model"]
