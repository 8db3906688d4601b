"""Filters and joins shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COMPLETED, SHOP_ORDER, Shop


def completed() -> Column:
    return F.col("status") == COMPLETED


def shop_order() -> Column:
    """A completed post of the order type."""
    return completed() & (F.col("post_type") == SHOP_ORDER)


def completed_orders(shop: Shop, with_type: bool = True) -> DataFrame:
    """Completed posts; ``with_type`` keeps only ``shop_order`` (some of the
    original statements omit the post-type test, so refunds count there)."""
    cond = completed()
    if with_type:
        cond = cond & (F.col("post_type") == SHOP_ORDER)
    return shop.orders.filter(cond)


def items_of(shop: Shop, item_type: str) -> DataFrame:
    return shop.items.filter(F.col("item_type") == item_type)


def date_hint(items: DataFrame, predicate) -> DataFrame:
    """Repeat an orders date predicate on the items' ``order_created``
    clustering column when the stored model has it (see
    ``sources.stored``), so the scan skips data outside the range.
    Only a pruning hint: the join to the filtered orders still decides."""
    if "order_created" in items.columns:
        return items.filter(predicate(F.col("order_created")))
    return items


#: Order columns that the stored model's items carry.
CARRIED = {"status": "order_status", "post_type": "order_post_type", "created": "order_created"}


def items_of_orders(shop: Shop, item_type: str, condition: Column, columns: list[str], **keep: Column) -> DataFrame:
    """``columns`` of the items whose order meets ``condition`` and, by name,
    ``keep``; both are expressions over an order's status, post_type and created.

    The stored model's items carry those three, so nothing is shuffled to look
    them up.  Other models, and orders repeated per term, are joined."""
    items = items_of(shop, item_type)
    if not shop.fanout and set(CARRIED.values()) <= set(items.columns):
        rows = items.select(*columns, *[F.col(c).alias(name) for name, c in CARRIED.items()])
        return rows.filter(condition).select(*columns, *[c.alias(name) for name, c in keep.items()])
    orders = shop.orders.filter(condition).select("order_id", *[c.alias(name) for name, c in keep.items()])
    return items.select(*columns).join(orders, "order_id").select(*columns, *keep)


def tagged_union(frames: dict[int, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Union of frames, each tagged with ``src`` and padded to ``columns``.

    Used to compute several independent global totals in ONE aggregation
    (instead of joining one-row results with a cross join).
    """
    out = None
    for tag, df in frames.items():
        have = set(df.columns)
        sel = [F.lit(tag).alias("src")] + [
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        part = df.select(*sel)
        out = part if out is None else out.unionByName(part)
    return out


def month_sums(value: str, months: int, prefix: str, zero: bool = False) -> list:
    """``sum(value)`` of each month 1..``months`` as columns ``<prefix><m>``
    (null when no row, or 0 with ``zero``).  Written as SQL expression text:
    one call per column instead of one per function (plan building cost)."""
    wrap = "coalesce({}, 0)" if zero else "{}"
    return [F.expr(wrap.format(f"sum(CASE WHEN month = {m} THEN {value} END)") + f" AS {prefix}{m}")
            for m in range(1, months + 1)]


def literal_ids(df_like: DataFrame, ids, name: str, dtype: str = "bigint") -> DataFrame:
    """A one-column frame of parameter values (no data passes the driver)."""
    spark = df_like.sparkSession
    values = [F.lit(v) for v in ids]
    if not values:
        return spark.range(0).select(F.lit(None).cast(dtype).alias(name))
    return spark.range(1).select(F.explode(F.array(*values).cast(f"array<{dtype}>")).alias(name))
