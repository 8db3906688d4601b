"""The shop model every report reads, and the report parameters.

Typed fact and dimension frames (money is DECIMAL(18,4), times are
TIMESTAMP_NTZ store-local wall clock):

    orders   (order_id, post_type, status, created, total, shipping, order_tax,
              shipping_tax, order_discount, cart_discount, customer_id)
    items    (order_id, item_type, item_name, product_id, qty, line_total,
              discount_amount, tax_amount, shipping_tax_amount)
    products (product_id, parent_id, post_type, post_status, title, sku,
              product_type, manage_stock, stock, stock_status)
    categories (term_id, parent_id, name); product_categories (product_id, term_id)
    coupons  (coupon_id, title, post_status)
    users    (user_id, role, user_registered)   -- counted as customers
    signups  (user_id, role, user_registered)   -- registration times

``customer_id`` is null when an order carries no customer key at all, 0 for
a guest.

``fanout`` marks a model whose order rows were repeated per term row of the
order (``legacy_fanout``), reproducing the original statements' unused join
on term relationships.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shop:
    orders: DataFrame
    items: DataFrame
    products: DataFrame
    categories: DataFrame
    product_categories: DataFrame
    coupons: DataFrame
    users: DataFrame
    signups: DataFrame
    fanout: bool = False

    def with_(self, **changes) -> "Shop":
        return replace(self, **changes)


def legacy_fanout(shop: Shop, term_relationships: DataFrame) -> Shop:
    """Repeat each order row once per term row of the order (at least once).

    The original statements left-join the term relationships on the order id
    without using a column, so an order with several terms is counted, and
    its items summed, once per term.  Reports join items to ``orders``, so
    the repetition reaches them on its own; the daily report, which groups
    by order id in the original, takes each order once.  The join is a
    left join on the order key (shuffle or broadcast as AQE measures).
    """
    terms = term_relationships.select(F.col("object_id").alias("order_id"), F.col("term_id").alias("_term"))
    orders = shop.orders.join(terms, "order_id", "left").drop("_term")
    return replace(shop, orders=orders.select(*shop.orders.columns), fanout=True)


COMPLETED = "wc-completed"
SHOP_ORDER = "shop_order"


@dataclass(frozen=True)
class Params:
    """Report parameters; reports never read the wall clock themselves."""

    now: dt.datetime = dt.datetime(1998, 9, 15, 12, 0, 0)
    year: int = 1998
    start: dt.date = dt.date(1998, 3, 1)
    end: dt.date = dt.date(1998, 3, 31)
    signup_now: dt.datetime = dt.datetime(2024, 1, 31, 12, 0, 0)
    products: tuple[int, ...] = (1, 2, 3)
    category_names: tuple[str, ...] = ("PROMO", "ECONOMY")
    coupons: tuple[str, ...] | None = None  # None: every used coupon
    low_stock: int = 5
    no_stock: int = 0


DEFAULT = Params()
