"""Named override points.

A caller may replace any intermediate frame of a report by passing
``hooks={"<point>": fn}``; ``fn(df, **context)`` returns the frame to use
instead (a filter, an extra column, a union with more rows...).  The points
are listed in ``POINTS``; the context keyword arguments are documented there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Hook = Callable[..., DataFrame]
Hooks = Mapping[str, Hook]

POINTS = {
    "totals.orders": "completed orders of the totals report",
    "totals.discounts": "completed orders feeding the discount total",
    "totals.shipping": "completed orders feeding the shipping total",
    "totals.items": "line items of completed posts (context: none)",
    "daily.orders": "orders in the day range (context: start, end)",
    "daily.order_items": "per-order item quantities (context: start, end)",
    "monthly.orders": "orders of the year (context: year)",
    "monthly.items": "line items of the year (context: year)",
    "top_sellers.items": "line items in range (context: start, end)",
    "top_earners.items": "line items in range (context: start, end)",
    "product_sales.items": "line items of the chosen products (context: product_ids)",
    "coupons.orders": "completed posts in range (context: start, end)",
    "coupons.items": "coupon items in range (context: start, end)",
    "coupons.totals": "coupon items of the usage overview (context: start, end)",
    "coupons.most_used": "coupon items of the most used list (context: start, end)",
    "coupons.greatest_discount": "coupon items of the greatest discount list (context: start, end)",
    "coupons.used": "coupon names ever used",
    "coupons.monthly": "coupon items of the year (context: year)",
    "customers.customer_orders": "orders with a customer",
    "customers.guest_orders": "orders of guests",
    "stock.candidates": "stock list candidates",
    "categories.items": "line items of the year (context: year)",
}


def apply(hooks: Hooks | None, point: str, df: DataFrame, **context) -> DataFrame:
    for name in hooks or ():
        if name not in POINTS:
            raise KeyError(f"unknown hook point {name!r}")
    if not hooks or point not in hooks:
        return df
    return hooks[point](df, **context)
