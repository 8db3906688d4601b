"""Shared fixtures: one local Spark session and a small typed-shop builder."""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tillroll.model import Shop  # noqa: E402
from tillroll.session import configure  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    ckpt = tempfile.mkdtemp(prefix="tillroll-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("tillroll-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


MONEY = "decimal(18,4)"
SCHEMAS = {
    "orders": [("order_id", "bigint"), ("post_type", "string"), ("status", "string"),
               ("created", "timestamp_ntz"), ("total", MONEY), ("shipping", MONEY),
               ("order_tax", MONEY), ("shipping_tax", MONEY), ("order_discount", MONEY),
               ("cart_discount", MONEY), ("customer_id", "bigint")],
    "items": [("order_id", "bigint"), ("item_type", "string"), ("item_name", "string"),
              ("product_id", "bigint"), ("qty", MONEY), ("line_total", MONEY),
              ("discount_amount", MONEY), ("tax_amount", MONEY), ("shipping_tax_amount", MONEY)],
    "products": [("product_id", "bigint"), ("parent_id", "bigint"), ("post_type", "string"),
                 ("post_status", "string"), ("title", "string"), ("sku", "string"),
                 ("product_type", "string"), ("manage_stock", "string"), ("stock", "string"),
                 ("stock_status", "string")],
    "categories": [("term_id", "bigint"), ("parent_id", "bigint"), ("name", "string")],
    "product_categories": [("product_id", "bigint"), ("term_id", "bigint")],
    "coupons": [("coupon_id", "bigint"), ("title", "string"), ("post_status", "string")],
    "users": [("user_id", "bigint"), ("role", "string"), ("user_registered", "timestamp_ntz")],
    "signups": [("user_id", "bigint"), ("role", "string"), ("user_registered", "timestamp_ntz")],
}


def frame(spark, table: str, rows: list[dict]):
    """A typed frame of ``table`` from dicts; missing keys are null."""
    cols = SCHEMAS[table]
    loose = ", ".join(f"`{c}` {'string' if t.startswith('decimal') else t}" for c, t in cols)
    data = [tuple(None if r.get(c) is None else
                  (str(r[c]) if t.startswith("decimal") else r[c]) for c, t in cols) for r in rows]
    df = spark.createDataFrame(data, loose)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in cols])


def make_shop(spark, **tables) -> Shop:
    """A ``Shop`` whose unspecified tables are empty."""
    return Shop(**{name: frame(spark, name, tables.get(name, [])) for name in SCHEMAS})


def order(order_id, created, total, status="wc-completed", post_type="shop_order", **kw):
    return {"order_id": order_id, "created": created, "total": total, "status": status,
            "post_type": post_type, **kw}


def line(order_id, qty, total=0, product_id=1):
    return {"order_id": order_id, "item_type": "line_item", "qty": qty, "line_total": total,
            "product_id": product_id}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def dec(x) -> Decimal:
    return Decimal(str(x))
