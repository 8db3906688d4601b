"""Report 9: customers versus guests, and sign-ups per day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.dates import ts_lit
from ..functions.numbers import MONEY, positive_or_null, round2_ratio
from ..model import DEFAULT, Params, Shop
from ..operators.calendar import day_spine, gap_fill
from .common import completed_orders, tagged_union


def customer_guest_overview(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(total_customers, total_customer_sales, total_guest_sales,
    total_customer_orders, total_guest_orders, orders_per_customer).

    An order is a customer's when its customer key is > 0, a guest's when
    it is 0; an order without that key, or without a total, is neither.  Customers are users with
    the ``customer`` role.  Everything is one global aggregation over a
    tagged union of the completed orders and the users; all values are null
    ("n/a") when not positive.
    """
    orders = completed_orders(shop).select("customer_id", "total")
    cust = H.apply(hooks, "customers.customer_orders", orders.filter(F.col("customer_id") > 0))
    guest = H.apply(hooks, "customers.guest_orders", orders.filter(F.col("customer_id") == 0))
    users = shop.users.filter(F.col("role") == "customer").select(F.lit(1).alias("one"))
    cols = {"customer_id": "bigint", "total": MONEY}
    if hooks and ({"customers.customer_orders", "customers.guest_orders"} & set(hooks)):
        u = tagged_union({1: cust, 2: guest, 3: users}, cols)
        is_c, is_g = F.col("src") == 1, F.col("src") == 2
    else:
        u = tagged_union({1: orders, 3: users}, cols)
        is_c = (F.col("src") == 1) & (F.col("customer_id") > 0)
        is_g = (F.col("src") == 1) & (F.col("customer_id") == 0)
    agg = u.agg(
        F.count(F.when(F.col("src") == 3, F.lit(1))).alias("users"),
        F.sum(F.when(is_c, F.col("total"))).alias("cs"), F.count(F.when(is_c, F.col("total"))).alias("co"),
        F.sum(F.when(is_g, F.col("total"))).alias("gs"), F.count(F.when(is_g, F.col("total"))).alias("go"))
    users_n, co = F.col("users"), F.col("co")
    return agg.select(
        positive_or_null(users_n).cast("bigint").alias("total_customers"),
        positive_or_null(F.col("cs")).cast("double").alias("total_customer_sales"),
        positive_or_null(F.col("gs")).cast("double").alias("total_guest_sales"),
        positive_or_null(co).cast("bigint").alias("total_customer_orders"),
        positive_or_null(F.col("go")).cast("bigint").alias("total_guest_orders"),
        F.when((co > 0) & (users_n > 0), round2_ratio(co, users_n)).alias("orders_per_customer"))


def signup_window(now: dt.datetime) -> tuple[dt.datetime, dt.date, int]:
    """(start instant, first calendar day, number of pre-seeded days)."""
    start = now - dt.timedelta(days=30)
    days = int((now - start).total_seconds() // 86400) or 1
    return start, start.date(), days


def in_signup_window(registered, now: dt.datetime):
    """After now - 30 days (a full timestamp); there is no upper bound."""
    start, _, _ = signup_window(now)
    return registered > ts_lit(start)


def customer_signups_daily(shop: Shop, params: Params = DEFAULT) -> DataFrame:
    """(day, signups) for the 30 days before ``signup_now``.

    Registrations count when strictly after now - 30 days (a full timestamp,
    so the first day is partial); a later day outside the pre-seeded 30
    (today, or one after it) appears only when it has sign-ups.
    """
    _, first_day, days = signup_window(params.signup_now)
    users = shop.signups.filter((F.col("role") == "customer")
                                & in_signup_window(F.col("user_registered"), params.signup_now))
    per_day = users.groupBy(F.to_date("user_registered").alias("day")).agg(
        F.count(F.lit(1)).alias("signups"))
    spine = day_spine(users.sparkSession, first_day, days)
    return gap_fill(spine, per_day, ["day"], {"signups": F.lit(0).cast("bigint")}, how="full")
