"""Raw shop tables (entity-attribute-value export) <-> shop model.

``read_raw`` loads the export (parquet, csv or a JDBC database — whatever
``spark.read`` supports), ``raw_to_shop`` turns it into the typed model
with one EAV pivot per entity, and ``star_to_raw`` writes the driver's star
tables in that raw form (used to test that both routes agree).

Raw tables:

    posts        (ID, post_type, post_status, post_date, post_title, post_parent)
    postmeta     (post_id, meta_key, meta_value)
    order_items  (order_item_id, order_id, order_item_type, order_item_name)
    order_itemmeta (order_item_id, meta_key, meta_value)
    product_types (product_id, product_type)
    term_relationships (object_id, term_id); category (term_id, parent_id, name)
    users        (user_id, role, user_registered)

Orders, products and coupons share the ``posts`` id space: in the export an
id is the source key times ``ID_KINDS`` plus the kind, so kinds never meet
whatever the keys.  Items are numbered by their line's rank in the whole
table, ``ITEM_KINDS`` ids to a line.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import MONEY
from ..model import Shop, legacy_fanout
from ..operators.eav import eav_pivot
from ..operators.stats import global_rank
from ..session import data_partitions, fingerprint, range_partitions, registry, scratch_path, sized
from . import star

ID_KINDS, ORDER_KIND, PRODUCT_KIND, COUPON_KIND = 4, 0, 1, 2
ITEM_KINDS = 3


def post_id(key, kind: int):
    """The export's post id of a source key (a column or a number)."""
    return key * ID_KINDS + kind


def source_key(post):
    """The source key of a post id (a column)."""
    return F.floor(post / ID_KINDS).cast("bigint")


ORDER_KEYS = {
    "_order_total": ("total", MONEY),
    "_order_shipping": ("shipping", MONEY),
    "_order_tax": ("order_tax", MONEY),
    "_order_shipping_tax": ("shipping_tax", MONEY),
    "_order_discount": ("order_discount", MONEY),
    "_cart_discount": ("cart_discount", MONEY),
    "_customer_user": ("customer_id", "bigint"),
}
ITEM_KEYS = {
    "_qty": ("qty", MONEY),
    "_line_total": ("line_total", MONEY),
    "_product_id": ("product_id", "bigint"),
    "discount_amount": ("discount_amount", MONEY),
    "tax_amount": ("tax_amount", MONEY),
    "shipping_tax_amount": ("shipping_tax_amount", MONEY),
}
PRODUCT_TEXT_KEYS = {"_manage_stock": "manage_stock", "_stock": "stock",
                     "_stock_status": "stock_status", "_sku": "sku"}
ORDER_TYPES = ("shop_order", "shop_order_refund")
PRODUCT_TYPES = ("product", "product_variation")


@dataclass(frozen=True)
class RawShop:
    posts: DataFrame
    postmeta: DataFrame
    order_items: DataFrame
    order_itemmeta: DataFrame
    product_types: DataFrame
    term_relationships: DataFrame
    categories: DataFrame
    users: DataFrame
    signups: DataFrame


class LazyRaw(RawShop):
    """Raw tables of which those given as functions are made when they are first read:
    a query over orders numbers and stores no item.  ``dealt`` may give the rows of a
    bucketed table dealt by its id to a number of partitions, made another way."""

    def __init__(self, dealt: dict[str, Callable[[int], DataFrame]] | None = None, **tables) -> None:
        object.__setattr__(self, "_tables", tables)
        object.__setattr__(self, "dealt", dealt or {})

    def __getattr__(self, name: str) -> DataFrame:  # a table that has not been read
        if name not in RAW_TABLES:
            raise AttributeError(name)
        table = self._tables[name]
        frame = table if isinstance(table, DataFrame) else table()
        object.__setattr__(self, name, frame)
        return frame

    def with_tables(self, **tables) -> LazyRaw:
        """These tables instead; the others stay unread."""
        dealt = {name: deal for name, deal in self.dealt.items() if name not in tables}
        return LazyRaw(dealt, **{name: self.__dict__.get(name, self._tables[name]) for name in RAW_TABLES} | tables)


RAW_TABLES = ("posts", "postmeta", "order_items", "order_itemmeta", "product_types",
              "term_relationships", "categories", "users", "signups")


RAW_SCHEMAS = {
    "posts": "ID bigint, post_type string, post_status string, post_date timestamp_ntz, "
             "post_title string, post_parent bigint",
    "postmeta": "post_id bigint, meta_key string, meta_value string",
    "order_items": "order_item_id bigint, order_id bigint, order_item_type string, order_item_name string",
    "order_itemmeta": "order_item_id bigint, meta_key string, meta_value string",
    "product_types": "product_id bigint, product_type string",
    "term_relationships": "object_id bigint, term_id bigint",
    "categories": "term_id bigint, parent_id bigint, name string",
    "users": "user_id bigint, role string, user_registered timestamp_ntz",
    "signups": "user_id bigint, role string, user_registered timestamp_ntz",
}
# Fixed value: the NULL marker of MySQL text exports.  CSV cannot tell an
# empty string from a null otherwise, and a blank stock is not a missing one.
CSV_OPTIONS = {"header": "true", "nullValue": "\\N"}


def jdbc_options(prefix: str, name: str, options: dict) -> dict[str, str]:
    """Reader options of one raw table in a database: its name, the declared
    column types, and, with ``lowerBound``, ``upperBound`` and
    ``numPartitions`` given, a parallel read split on the table's first id."""
    schema = RAW_SCHEMAS[name]
    opts = {**{k: str(v) for k, v in options.items()}, "dbtable": f"{prefix}{name}", "customSchema": schema}
    if {"lowerBound", "upperBound", "numPartitions"} <= set(options):
        opts["partitionColumn"] = schema.split()[0]
    return opts


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> RawShop:
    """Load an export written as one folder/table per raw table (parquet,
    CSV, JSON...), or the tables of a database (``fmt="jdbc"``: ``path`` is the
    table prefix, ``options`` has the url and driver; see ``jdbc_options``).
    Text formats get the declared schemas (no inference pass over the
    export) and, for CSV, MySQL's ``\\N`` null marker unless overridden."""
    text = fmt in ("csv", "json")
    opts = {**(CSV_OPTIONS if fmt == "csv" else {}), **options}

    def load(name: str) -> DataFrame:
        if fmt == "jdbc":
            return spark.read.format("jdbc").options(**jdbc_options(path, name, options)).load()
        reader = spark.read.format(fmt).options(**opts)
        if text:
            reader = reader.schema(RAW_SCHEMAS[name])
        return reader.load(f"{path.rstrip('/')}/{name}")
    return RawShop(**{name: load(name) for name in RAW_TABLES})


def write_raw(raw: RawShop, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    opts = {**(CSV_OPTIONS if fmt == "csv" else {}), **options}
    for name in RAW_TABLES:
        getattr(raw, name).write.format(fmt).options(**opts).mode(mode).save(f"{path.rstrip('/')}/{name}")


#: Tables that joins and pivots read by an id, and that id.
BUCKETED = {"posts": "ID", "postmeta": "post_id", "order_items": "order_item_id", "order_itemmeta": "order_item_id"}
#: Tables of items, and the column that their stored form has when items are numbered
#: through: the range of ids that a row lies in.
ITEM_TABLES, ID_RANGE = ("order_items", "order_itemmeta"), "id_range"


def _id_ranges(df: DataFrame, last: int, buckets: int) -> DataFrame:
    """``df`` with its range of item ids, of ``buckets`` equal ones up to ``last``.  A
    range's number is the least that Spark's hash puts in a bucket of its own."""
    numbers = df.sparkSession.range(64 * buckets).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("_nth")).agg(
        F.min("id").alias(ID_RANGE))
    nth = F.least(F.floor(F.col("order_item_id") * buckets / F.lit(last + 1)).cast("int"), F.lit(buckets - 1))
    return (df.withColumn("_nth", nth).join(F.broadcast(numbers), "_nth", "left")
            .select(*df.columns, F.coalesce(ID_RANGE, F.col("_nth").cast("bigint")).alias(ID_RANGE)))


def store_raw(raw: RawShop, folder: str, buckets: int, last_item: Callable[[], int] | None = None) -> LazyRaw:
    """``raw`` as tables under ``folder``, each stored when it is first read, the large
    ones bucketed and sorted by the id their joins and pivots use: with equal bucket
    counts neither shuffles.  Set ``buckets`` to the data (one task reads one); the
    tables' entries live in the session's catalog.

    ``last_item`` is given when items are numbered through up to that id and their rows
    come in that order.  Their tables are then bucketed by equal ranges of ids and stored
    where they are: a task writes the few ranges that its rows lie in, and nothing is
    shuffled.  Joins within ranges shuffle nothing with
    ``spark.sql.requireAllClusterKeysForCoPartition`` off (see ``operators_demo``)."""
    spark = raw.posts.sparkSession
    name_of = f"tillroll_raw_{uuid.uuid4().hex[:12]}"
    last = cache(last_item or (lambda: 0))

    def store(name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        with sized(spark, buckets):
            if name not in BUCKETED:
                getattr(raw, name).write.parquet(path)
                return spark.read.parquet(path)
            by, deal = BUCKETED[name], getattr(raw, "dealt", {}).get(name)
            if last_item is not None and name in ITEM_TABLES:
                bucketed = _id_ranges(getattr(raw, name), last(), buckets).write.bucketBy(buckets, ID_RANGE)  # in order as they come
            else:
                # dealt as the buckets are: a task writes rows of one bucket
                dealt = getattr(raw, name).repartition(buckets, by) if deal is None else deal(buckets)
                bucketed = dealt.write.bucketBy(buckets, by).sortBy(by)
            bucketed.option("path", path).format("parquet").saveAsTable(f"{name_of}_{name}")
        return spark.table(f"{name_of}_{name}")

    return LazyRaw(**{name: (lambda name=name: store(name)) for name in RAW_TABLES})


_EXPORTS: dict[tuple[str, str], tuple[str, RawShop]] = registry()


def exported_raw(spark: SparkSession, sf_dir: str) -> RawShop:
    """The driver tables of ``sf_dir`` in raw export form, each stored once per
    session, at its first use, under the shared checkpoint folder (anew when the files
    have changed), in buckets in proportion to the files.

    A shop's export is a set of stored tables; the operator queries over it
    (EAV pivots, semi-joins, coercion) read those tables, with the key
    filter pushed to the scan, instead of re-deriving them every time.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    files = [f"{key[1]}/{name}.parquet" for name in star.TABLES]
    now = fingerprint(spark, files)
    if key not in _EXPORTS or _EXPORTS[key][0] != now:
        last_item = lambda: (star.read_table(spark, sf_dir, "lineitem").count() + 1) * ITEM_KINDS - 1
        raw = store_raw(star_to_raw(spark, sf_dir), scratch_path(spark, "raw-export"), data_partitions(spark, files), last_item)
        _EXPORTS[key] = now, raw
    return _EXPORTS[key][1]


def raw_orders(raw: RawShop, checks: Observation | None = None, repeated: str | None = None) -> DataFrame:
    """The orders of an export; ``checks`` and ``repeated`` as in ``eav_pivot``."""
    posts = raw.posts.filter(F.col("post_type").isin(*ORDER_TYPES)).select(
        F.col("ID").alias("order_id"), "post_type", F.col("post_status").alias("status"),
        F.col("post_date").alias("created"))
    meta = eav_pivot(raw.postmeta, "post_id", numeric=ORDER_KEYS, checks=checks, repeated=repeated).withColumnRenamed("post_id", "order_id")
    return posts.join(meta, "order_id", "left").select(
        "order_id", "post_type", "status", "created", "total", "shipping", "order_tax", "shipping_tax",
        "order_discount", "cart_discount", "customer_id", *([] if repeated is None else [repeated]))


def raw_items(raw: RawShop) -> DataFrame:
    # items stored by ranges of their ids are joined within them
    ids = ["order_item_id"] + [ID_RANGE] * all(ID_RANGE in getattr(raw, name).columns for name in ITEM_TABLES)
    items = raw.order_items.select(
        *ids, "order_id", F.col("order_item_type").alias("item_type"),
        F.col("order_item_name").alias("item_name"))
    meta = eav_pivot(raw.order_itemmeta, ids, numeric=ITEM_KEYS)
    return items.join(meta, ids, "left").select(
        "order_item_id", *star.ITEM_COLUMNS)


def raw_products(raw: RawShop) -> DataFrame:
    posts = raw.posts.filter(F.col("post_type").isin(*PRODUCT_TYPES)).select(
        F.col("ID").alias("product_id"),
        F.when(F.col("post_parent") > 0, F.col("post_parent")).alias("parent_id"),
        "post_type", "post_status", F.col("post_title").alias("title"))
    meta = eav_pivot(raw.postmeta, "post_id", text=PRODUCT_TEXT_KEYS).withColumnRenamed("post_id", "product_id")
    return (posts.join(meta, "product_id", "left").join(raw.product_types, "product_id", "left")
            .select("product_id", "parent_id", "post_type", "post_status", "title", "sku", "product_type",
                    "manage_stock", "stock", "stock_status"))


def raw_to_shop(raw: RawShop, coupons: DataFrame | None = None, fanout: bool = False, checks: Observation | None = None) -> Shop:
    """The typed model of a raw export; ``fanout`` repeats order rows per
    term row of the order as the original statements do (see
    ``model.legacy_fanout``).  ``checks`` observes the coercion of the orders' values
    when a report first reads them."""
    items = raw_items(raw).drop("order_item_id")
    coupon_posts = raw.posts.filter(F.col("post_type") == "shop_coupon").select(
        F.col("ID").alias("coupon_id"), F.col("post_title").alias("title"), "post_status")
    shop = Shop(
        orders=raw_orders(raw, checks), items=items, products=raw_products(raw), categories=raw.categories,
        product_categories=raw.term_relationships.select(F.col("object_id").alias("product_id"), "term_id"),
        coupons=coupon_posts if coupons is None else coupons, users=raw.users, signups=raw.signups)
    return legacy_fanout(shop, raw.term_relationships) if fanout else shop


# -- star -> raw export -------------------------------------------------------

def _meta(df: DataFrame, id_col: str, pairs: dict[str, str], out_id: str) -> DataFrame:
    """Unpivot typed columns into (id, meta_key, meta_value) text rows,
    skipping nulls (a missing key has no row)."""
    stack = ", ".join(f"'{k}', CAST(`{c}` AS STRING)" for k, c in pairs.items())
    return (df.selectExpr(f"`{id_col}` AS {out_id}", f"stack({len(pairs)}, {stack}) AS (meta_key, meta_value)")
            .filter(F.col("meta_value").isNotNull()))


def star_to_raw(spark: SparkSession, sf_dir: str) -> LazyRaw:
    """The star tables as a raw export; lines are numbered when items are first read."""
    typed = star.load_shop(spark, sf_dir)
    orders = typed.orders.withColumn("order_id", post_id(F.col("order_id"), ORDER_KIND))
    order_posts = orders.select(
        F.col("order_id").alias("ID"), "post_type", F.col("status").alias("post_status"),
        F.col("created").alias("post_date"),
        F.concat(F.lit("Order #"), source_key(F.col("order_id")).cast("string")).alias("post_title"),
        F.lit(0).cast("bigint").alias("post_parent"))

    products = typed.products.withColumn("ID", post_id(F.col("product_id"), PRODUCT_KIND))
    product_posts = products.select(
        "ID", "post_type", "post_status", F.lit(None).cast("timestamp_ntz").alias("post_date"),
        F.col("title").alias("post_title"),
        F.coalesce(post_id(F.col("parent_id"), PRODUCT_KIND), F.lit(0).cast("bigint")).alias("post_parent"))

    def post_meta(buckets: int | None = None) -> DataFrame:
        # orders and products are dealt, not their meta rows, of which each has up to seven
        deal = lambda df, by: df if buckets is None else df.repartition(buckets, by)
        return _meta(deal(orders, "order_id"), "order_id", {k: v[0] for k, v in ORDER_KEYS.items()}, "post_id").unionByName(
            _meta(deal(products.select("ID", *PRODUCT_TEXT_KEYS.values()), "ID"), "ID", PRODUCT_TEXT_KEYS, "post_id"))

    coupon_posts = typed.coupons.select(
        post_id(F.col("coupon_id"), COUPON_KIND).alias("ID"), F.lit("shop_coupon").alias("post_type"), "post_status",
        F.lit(None).cast("timestamp_ntz").alias("post_date"), F.col("title").alias("post_title"),
        F.lit(0).cast("bigint").alias("post_parent"))

    @cache
    def items() -> DataFrame:
        lineitem = star.read_table(spark, sf_dir, "lineitem")
        order = list(dict.fromkeys(["l_orderkey", *lineitem.columns]))
        numbered = global_rank(lineitem, order, range_partitions(spark))
        rows = star.item_rows_one_pass(numbered, item_id=F.col("_rn") * ITEM_KINDS)
        return rows.withColumns({"order_id": post_id(F.col("order_id"), ORDER_KIND),
                                 "product_id": post_id(F.col("product_id"), PRODUCT_KIND)})

    def order_items() -> DataFrame:
        return items().select("order_item_id", "order_id", F.col("item_type").alias("order_item_type"),
                              F.col("item_name").alias("order_item_name"))

    def item_meta() -> DataFrame:
        return _meta(items(), "order_item_id", {k: v[0] for k, v in ITEM_KEYS.items()}, "order_item_id")

    cats = typed.categories
    rels = typed.product_categories.select(
        post_id(F.col("product_id"), PRODUCT_KIND).alias("object_id"), "term_id")
    return LazyRaw(
        dealt={"postmeta": post_meta},
        posts=order_posts.unionByName(product_posts).unionByName(coupon_posts),
        postmeta=post_meta,
        order_items=order_items, order_itemmeta=item_meta,
        product_types=products.filter(F.col("product_type").isNotNull()).select(
            F.col("ID").alias("product_id"), "product_type"),
        term_relationships=rels, categories=cats, users=typed.users, signups=typed.signups)
