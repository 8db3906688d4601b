"""Driver star schema (orders, lineitem, part, customer, events) -> shop model.

The shop model is what every report reads (see ``tillroll.model.Shop``).
The mapping is a fixed rule set so that the same shop can be rebuilt in any
SQL engine (the DuckDB oracle in ``tillroll.oracle`` writes the same rules):

* order status F/O/P -> wc-completed / wc-processing / wc-on-hold;
* every 50th order (key % 50 = 7) is a refund post (``shop_order_refund``);
* created = order date + (key % 24) hours;
* shipping by priority 1..5 = 25 / 15 / 10 / 7.5 / 5, shipping tax 8 %;
* guest order (customer 0) when custkey % 10 = 0;
* each line gives a line item (quantity negated on refunds), a coupon item
  ``SAVE<pct>-<returnflag>`` when discounted and a tax item ``VAT<pct>``
  when taxed; the order's cart discount and tax are the sums of those;
* parts become products: variation when key % 7 = 3 (parent key - 1),
  sku ``SKU<key>`` for even keys, managed stock unless key % 4 = 0,
  stock = size - 5 (blank when size % 13 = 0), flagged out of stock when
  size % 10 = 0, ``variable`` type for LARGE/MEDIUM;
* categories: one root per part type and one child per (type, brand);
  a part belongs to its child term only;
* coupon posts exist (published) for odd percentages, plus a trashed
  duplicate title with a lower id when the percentage is a multiple of 3.

Nothing here collects: every frame is a lazy projection/aggregate of the
parquet scans, so Catalyst prunes columns and pushes filters to the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import MONEY
from ..model import Shop

TABLES = ("orders", "lineitem", "part", "customer", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(c) -> F.Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def _price(c: str) -> F.Column:
    """A line amount as DECIMAL(18,2), like every amount of the model."""
    return F.col(c).cast("decimal(18,2)")


def _rate(c: str) -> F.Column:
    """A rate (discount, tax) as DECIMAL(10,6): 0.075 keeps its digits."""
    return F.col(c).cast("decimal(10,6)")


def _pct(c: str) -> F.Column:
    """The whole percent of a rate, for names; the amount uses the rate."""
    return F.floor(_rate(c) * 100).cast("int")


def order_core(orders: DataFrame, *others: F.Column) -> DataFrame:
    """The order columns that need no item, and ``others``."""
    key = F.col("o_orderkey")
    priority = F.substring("o_orderpriority", 1, 1)
    shipping = (F.when(priority == "1", F.lit(25)).when(priority == "2", F.lit(15))
                .when(priority == "3", F.lit(10)).when(priority == "4", F.lit(7.5))
                .otherwise(F.lit(5))).cast(MONEY)
    status = F.col("o_orderstatus")
    return orders.select(
        key.alias("order_id"),
        F.when(key % 50 == 7, F.lit("shop_order_refund")).otherwise(F.lit("shop_order")).alias("post_type"),
        F.when(status == "F", F.lit("wc-completed")).when(status == "O", F.lit("wc-processing"))
         .when(status == "P", F.lit("wc-on-hold")).alias("status"),
        F.timestamp_add("HOUR", (key % 24).cast("int"), F.col("o_orderdate")).alias("created"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
        shipping.alias("shipping"),
        (shipping * F.lit(0.08).cast("decimal(4,2)")).cast(MONEY).alias("shipping_tax"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit(0).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias("customer_id"),
        *others,
    )


def _by_order(lineitem: DataFrame) -> DataFrame:
    """The amounts of the lines that have an order, brought together by it.  Sums of a few
    lines are wider than the lines: lines are moved, and summed where they arrive."""
    return lineitem.filter(F.col("l_orderkey").isNotNull()).select(
        "l_orderkey", _money("l_quantity").alias("quantity"), _price("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") > 0, _rate("l_discount")).alias("discount"),
        _rate("l_tax").alias("tax")).repartition("l_orderkey")


def _money_sums() -> list:
    return [F.sum(F.col("price") * F.col("tax")).cast(MONEY).alias("order_tax"),
            F.coalesce(F.sum(F.col("price") * F.col("discount")), F.lit(0)).cast(MONEY).alias("cart_discount")]


def order_money(lineitem: DataFrame) -> DataFrame:
    """Per-order tax and coupon discount: one aggregate keyed by order."""
    return _by_order(lineitem).groupBy(F.col("l_orderkey").alias("money_order_id")).agg(*_money_sums())


def order_fact(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with their money columns.

    The money side is unique per order (an aggregate on the key), so a report
    that reads no money column gets the join removed by Catalyst.
    """
    return _with_money(order_core(orders), order_money(lineitem))


def _with_money(core: DataFrame, money: DataFrame, *others: str) -> DataFrame:
    return (core.join(money, core.order_id == money.money_order_id, "left")
            .select(
                "order_id", "post_type", "status", "created", "total", "shipping",
                F.coalesce("order_tax", F.lit(0).cast(MONEY)).alias("order_tax"),
                "shipping_tax",
                F.lit(0).cast(MONEY).alias("order_discount"),
                F.coalesce("cart_discount", F.lit(0).cast(MONEY)).alias("cart_discount"),
                "customer_id", *others))


def measured_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``order_fact`` with ``line_measures``, from one aggregate of the lines."""
    qty = F.when(F.col("l_orderkey") % 50 == 7, -F.col("quantity")).otherwise(F.col("quantity")).cast(MONEY)
    discount = (F.col("price") * F.col("discount")).cast(MONEY)
    sums = _by_order(lineitem).groupBy(F.col("l_orderkey").alias("money_order_id")).agg(
        *_money_sums(), F.sum(qty).alias("line_qty"), F.count(discount).alias("coupon_uses"), F.sum(discount).alias("coupon_discount"))
    return _with_money(order_core(orders), sums, "line_qty", "coupon_uses", "coupon_discount")


ITEM_COLUMNS = ("order_id", "item_type", "item_name", "product_id", "qty", "line_total",
                "discount_amount", "tax_amount", "shipping_tax_amount")


def item_fact(lineitem: DataFrame, item_id: F.Column | None = None) -> DataFrame:
    """Line, coupon and tax items as a union of three projections.

    A report filtering on ``item_type`` keeps one branch: the others fold to
    empty relations at optimisation time, so only one scan remains.  With
    ``item_id`` (a per-line base id) each item also gets ``order_item_id`` =
    base + 0 / 1 / 2 for its line / coupon / tax item.
    """
    def ids(kind: int) -> list:
        return [] if item_id is None else [(item_id + kind).alias("order_item_id")]

    order_id = F.col("l_orderkey").alias("order_id")
    refund = F.col("l_orderkey") % 50 == 7
    none_money = F.lit(None).cast(MONEY)
    qty = F.when(refund, -_money("l_quantity")).otherwise(_money("l_quantity")).cast(MONEY)
    line = lineitem.select(
        *ids(0), order_id, F.lit("line_item").alias("item_type"), F.lit(None).cast("string").alias("item_name"),
        F.col("l_partkey").alias("product_id"), qty.alias("qty"),
        _money("l_extendedprice").cast(MONEY).alias("line_total"),
        none_money.alias("discount_amount"), none_money.alias("tax_amount"),
        none_money.alias("shipping_tax_amount"))
    coupon = lineitem.filter(F.col("l_discount") > 0).select(
        *ids(1), order_id, F.lit("coupon").alias("item_type"),
        F.concat(F.lit("SAVE"), _pct("l_discount").cast("string"), F.lit("-"),
                 F.col("l_returnflag")).alias("item_name"),
        F.lit(None).cast("bigint").alias("product_id"), none_money.alias("qty"),
        none_money.alias("line_total"),
        (_price("l_extendedprice") * _rate("l_discount")).cast(MONEY).alias("discount_amount"),
        none_money.alias("tax_amount"), none_money.alias("shipping_tax_amount"))
    tax = lineitem.filter(F.col("l_tax") > 0).select(
        *ids(2), order_id, F.lit("tax").alias("item_type"),
        F.concat(F.lit("VAT"), _pct("l_tax").cast("string")).alias("item_name"),
        F.lit(None).cast("bigint").alias("product_id"), none_money.alias("qty"),
        none_money.alias("line_total"), none_money.alias("discount_amount"),
        (_price("l_extendedprice") * _rate("l_tax")).cast(MONEY).alias("tax_amount"),
        (_price("l_quantity") * _rate("l_tax")).cast(MONEY).alias("shipping_tax_amount"))
    return line.unionByName(coupon).unionByName(tax)


def line_amounts(lineitem: DataFrame, *others: F.Column | str) -> DataFrame:
    """What a line's items are made of, and ``others``: its order and product, quantity and
    price as decimals, the rates of discount and tax where the line has such an item (else
    null), its flag.  A double is made a decimal once, wherever the lines go then."""
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        _money("l_quantity").alias("quantity"), _price("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") > 0, _rate("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0, _rate("l_tax")).alias("tax"), F.col("l_returnflag").alias("flag"), *others)


def items_of_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The items of ``line_amounts`` rows: each line is repeated for its line item and, when
    discounted / taxed, its coupon and tax item, and each copy makes the columns of its kind.
    ``keep`` names columns of the lines that their items carry on; with a column ``item_id``
    (a per-line base id) items get ``order_item_id``."""
    numbered = "item_id" in lines.columns
    price, discount, tax = F.col("price"), F.col("discount"), F.col("tax")
    line, coupon, taxed = (F.col("_kind") == n for n in range(3))
    qty = F.when(F.col("order_id") % 50 == 7, -F.col("quantity")).otherwise(F.col("quantity")).cast(MONEY)
    pct = lambda rate: F.floor(rate * 100).cast("int").cast("string")
    columns = {
        "item_type": F.when(line, "line_item").when(coupon, "coupon").otherwise("tax"),
        "item_name": F.when(coupon, F.concat(F.lit("SAVE"), pct(discount), F.lit("-"), F.col("flag")))
                      .when(taxed, F.concat(F.lit("VAT"), pct(tax))),
        "product_id": F.when(line, F.col("product_id").cast("bigint")), "qty": F.when(line, qty),
        "line_total": F.when(line, price.cast(MONEY)), "discount_amount": F.when(coupon, (price * discount).cast(MONEY)),
        "tax_amount": F.when(taxed, (price * tax).cast(MONEY)),
        "shipping_tax_amount": F.when(taxed, (F.col("quantity") * tax).cast(MONEY))}
    kinds = F.array(F.lit(0), F.when(discount.isNotNull(), 1), F.when(tax.isNotNull(), 2))
    # a kind that the line has not explodes to null, dropped by the filter
    copies = lines.withColumn("_kind", F.explode(kinds)).filter(F.col("_kind").isNotNull())
    return copies.select(*([(F.col("item_id") + F.col("_kind")).alias("order_item_id")] if numbered else []), "order_id",
                         *[c.alias(name) for name, c in columns.items()], *keep)


def item_rows_one_pass(lineitem: DataFrame, item_id: F.Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same rows as ``item_fact`` from ONE scan of the lines (see ``items_of_lines``).
    Used when every kind is needed at once (storing the model or the export); a report
    reading one kind is better served by ``item_fact``, whose other branches are pruned."""
    return items_of_lines(line_amounts(lineitem, *keep, *([] if item_id is None else [item_id.alias("item_id")])), keep)


#: The columns of a line that its items are made of.
ITEM_SOURCE = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def line_measures(lineitem: DataFrame) -> DataFrame:
    """``stored.order_measures`` of the lines' items, read off the lines."""
    refund = F.col("l_orderkey") % 50 == 7
    qty = F.when(refund, -_money("l_quantity")).otherwise(_money("l_quantity")).cast(MONEY)
    discount = F.when(F.col("l_discount") > 0, (_price("l_extendedprice") * _rate("l_discount")).cast(MONEY))
    return lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.sum(qty).alias("line_qty"), F.count(discount).alias("coupon_uses"), F.sum(discount).alias("coupon_discount"))


def product_dim(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    variation = key % 7 == 3
    size = F.col("p_size")
    return part.select(
        key.alias("product_id"),
        F.when(variation, key - 1).alias("parent_id"),
        F.when(variation, F.lit("product_variation")).otherwise(F.lit("product")).alias("post_type"),
        F.lit("publish").alias("post_status"),
        F.col("p_name").alias("title"),
        F.when(key % 2 == 0, F.concat(F.lit("SKU"), key.cast("string"))).alias("sku"),
        F.when(variation, F.lit(None).cast("string"))
         .when(F.col("p_type").isin("LARGE", "MEDIUM"), F.lit("variable"))
         .otherwise(F.lit("simple")).alias("product_type"),
        F.when(key % 4 != 0, F.lit("yes")).otherwise(F.lit("no")).alias("manage_stock"),
        F.when(size % 13 == 0, F.lit("")).otherwise((size - 5).cast("string")).alias("stock"),
        F.when(size % 10 == 0, F.lit("outofstock")).otherwise(F.lit("instock")).alias("stock_status"),
    )


def _child_terms(part: DataFrame) -> DataFrame:
    return part.groupBy("p_type", "p_brand").agg(
        (F.min("p_partkey") + 2_000_000).alias("term_id"))


def _root_terms(part: DataFrame) -> DataFrame:
    return part.groupBy("p_type").agg((F.min("p_partkey") + 1_000_000).alias("root_id"))


def category_dim(part: DataFrame) -> DataFrame:
    """Category terms; ids come from aggregates, so no window or collect."""
    roots = _root_terms(part)
    children = _child_terms(part).join(roots, "p_type")
    return (roots.select(F.col("root_id").alias("term_id"), F.lit(0).cast("bigint").alias("parent_id"),
                         F.col("p_type").alias("name"))
            .unionByName(children.select(
                "term_id", F.col("root_id").alias("parent_id"),
                F.concat_ws("/", "p_type", "p_brand").alias("name"))))


def product_category(part: DataFrame) -> DataFrame:
    children = _child_terms(part)
    return part.select("p_partkey", "p_type", "p_brand").join(children, ["p_type", "p_brand"]).select(
        F.col("p_partkey").alias("product_id"), "term_id")


def coupon_dim(items: DataFrame) -> DataFrame:
    names = (items.filter(F.col("item_type") == "coupon").select("item_name").distinct()
             .select("item_name",
                     F.regexp_extract("item_name", r"^SAVE(\d+)-", 1).cast("int").alias("pct"),
                     F.ascii(F.regexp_extract("item_name", r"-(.)$", 1)).alias("flag")))
    base = F.lit(1000) + F.col("pct") * 100 + F.col("flag")
    published = names.filter(F.col("pct") % 2 == 1).select(
        base.cast("bigint").alias("coupon_id"), F.col("item_name").alias("title"),
        F.lit("publish").alias("post_status"))
    trashed = names.filter(F.col("pct") % 3 == 0).select(
        (base - 50).cast("bigint").alias("coupon_id"), F.col("item_name").alias("title"),
        F.lit("trash").alias("post_status"))
    return published.unionByName(trashed)


def user_dim(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("user_id"), F.lit("customer").alias("role"),
                           F.lit(None).cast("timestamp_ntz").alias("user_registered"))


def signup_dim(events: DataFrame) -> DataFrame:
    # an event that arrives twice is one sign-up, as in the stream; without an id each row is one
    signups = events.filter(F.col("event_type") == "signup")
    once = signups.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(
        F.min(F.struct("ts", "user_id")).alias("e")).select("e.user_id", "e.ts")
    every = once.unionByName(signups.filter(F.col("event_id").isNull()).select("user_id", "ts"))
    return every.select("user_id", F.lit("customer").alias("role"), F.col("ts").alias("user_registered"))


def load_shop(spark: SparkSession, sf_dir: str) -> Shop:
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    items = item_fact(lineitem)
    return Shop(
        orders=order_fact(orders, lineitem),
        items=items,
        products=product_dim(part),
        categories=category_dim(part),
        product_categories=product_category(part),
        coupons=coupon_dim(items),
        users=user_dim(read_table(spark, sf_dir, "customer")),
        signups=signup_dim(read_table(spark, sf_dir, "events")),
    )
