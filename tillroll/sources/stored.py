"""The stored shop model: parquet tables for the reports' access paths, kept up to
date by rewriting only the slices that changed rows touch.

``orders`` and ``items`` are cut into slices, ranges of their order's ``created``
(ties by order id), each a folder ``<table>/v=<version>/slice=<number>`` (items
below it by ``item_type``).  A manifest says which version of each slice is
current and what range it covers; it is published by a rename
(``session.publish``), so a reader or a crash sees the old model or the new one.

* Reports filter a date range, pushed to the scan, and slices are sorted by it, so
  row-group statistics skip what lies outside.
* Items carry their order's status, type and ``created``: a report reads only one
  kind and its range and needs no join to test an order's status.
* Orders carry what the daily and the coupon overview need of their items, the sum
  of quantities and the number and sum of coupon discounts: neither joins them.

``refresh`` takes changed and new rows.  Orders later than all others become a slice
of their own; otherwise the slices that hold an old or a new version of a changed
order are written anew, and the others stay as they are.  When the slices have
doubled in number all are written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import Shop
from ..session import file_system, publish, published, sized

CARRIED = {"order_status": "status", "order_post_type": "post_type", "order_created": "created"}
MEASURES = ("line_qty", "coupon_uses", "coupon_discount")
SORTED_BY = {"orders": "created", "items": "order_created"}
Unpack = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def order_measures(items: DataFrame) -> DataFrame:
    """(order_id, line_qty, coupon_uses, coupon_discount): what an order's items add
    up to, as the daily summary and the coupon overview sum them."""
    coupon = F.when(F.col("item_type") == "coupon", F.col("discount_amount"))
    return items.groupBy("order_id").agg(
        F.sum(F.when(F.col("item_type") == "line_item", F.col("qty"))).alias("line_qty"),
        F.count(coupon).alias("coupon_uses"), F.sum(coupon).alias("coupon_discount"))


def _carried(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", *[F.col(c).alias(name) for name, c in CARRIED.items()])


def _as(df: DataFrame) -> list:
    """The columns of ``df`` in its types."""
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema]


class StoredShop:
    """The typed model as tables under a shared folder, each written when a report
    first reads it (a report on products alone writes no order).  A folder that
    already has a manifest is read as it is.  Other attributes are those of ``Shop``.

    ``partitions`` is the number of slices of a table at first and the least number of
    shuffle partitions while it is made; set it to the data.  Files larger than
    ``spark.sql.files.maxPartitionBytes`` are read split by row group, so it bounds
    write parallelism, not read parallelism.

    ``lines`` may give the items packed, several to a row with its ``order_id``, and
    ``unpack(rows, keep)`` makes items of such rows, which carry on the columns
    ``keep``: the packed rows are moved, and unpacked by the task that writes them.
    ``measures`` may give ``order_measures`` of the items made another way, and
    ``measured`` the orders that have them already.
    """

    fanout = False

    def __init__(self, shop: Shop, folder: str, partitions: int, items: DataFrame | None = None,
                 coupons: Callable[[DataFrame], DataFrame] | None = None, lines: DataFrame | None = None,
                 unpack: Unpack | None = None, measures: DataFrame | None = None, measured: DataFrame | None = None) -> None:
        self._shop, self._root, self._partitions = shop, folder.rstrip("/"), partitions
        self._items = shop.items if items is None else items
        self._lines, self._unpack, self._measures, self._measured = lines, unpack, measures, measured
        self._coupons = coupons
        self._spark = shop.orders.sparkSession
        self._load()

    def _load(self) -> None:
        self._version, text = published(self._spark, f"{self._root}/manifests")
        self._manifest: dict[str, dict] = json.loads(text) if text else {}

    def _next(self) -> str:
        """A version's folder name; no two attempts share one."""
        return f"{self._version + 1}-{uuid.uuid4().hex[:8]}"

    # -- slices ------------------------------------------------------------------

    def _write(self, name: str, df: DataFrame, version: str) -> dict[str, dict]:
        """Write the slices of ``df`` (column ``slice``); what the manifest says of them."""
        folder, by = f"{self._root}/{name}/v={version}", SORTED_BY[name]
        parts = ["slice", "item_type"] if name == "items" else ["slice"]
        df.write.partitionBy(*parts).parquet(folder)
        got = self._spark.read.schema(df.schema).parquet(folder).groupBy("slice").agg(
            F.min(by).cast("string").alias("lo"), F.max(by).cast("string").alias("hi")).collect()
        return {str(r["slice"]): {"v": version, "lo": r["lo"], "hi": r["hi"]} for r in got}

    def _sliced(self, name: str, df: DataFrame) -> DataFrame:
        # order_id breaks ties, so one hot timestamp (a bulk import) still
        # spreads over several slices instead of filling one
        by = [SORTED_BY[name], "order_id"]
        ranged = df.repartitionByRange(self._partitions, *by).withColumn("slice", F.spark_partition_id())
        return ranged.sortWithinPartitions("slice", *by)

    def _publish(self, **tables: dict[str, dict]) -> bool:
        """Make a manifest with ``tables`` the current one, unless another writer was first."""
        manifest = {**self._manifest, **tables}
        if not publish(self._spark, f"{self._root}/manifests", self._version + 1, json.dumps(manifest)):
            return False
        self._manifest, self._version = manifest, self._version + 1
        return True

    def _first(self, name: str, df: DataFrame, unpack: Unpack | None = None) -> None:
        while name not in self._manifest:
            sliced = self._sliced(name, df)
            if unpack is not None:
                sliced = unpack(sliced, (*CARRIED, "slice"))
            with sized(self._spark, self._partitions):
                slices = self._write(name, sliced, self._next())
            if not self._publish(**{name: {"schema": sliced.schema.json(), "slices": slices, "first": len(slices)}}):
                self._load()

    def _read(self, name: str, slices: list[str] | None = None) -> DataFrame:
        """The table, or some of its slices with their number."""
        table = self._manifest[name]
        schema = StructType.fromJson(json.loads(table["schema"]))
        have = table["slices"] if slices is None else {s: table["slices"][s] for s in slices}
        paths = [f"{self._root}/{name}/v={e['v']}/slice={s}" for s, e in have.items()]
        reader = self._spark.read.schema(schema).option("basePath", f"{self._root}/{name}")
        # without the version, which the folders' names give
        frame = reader.parquet(*paths).select(*schema.names) if paths else self._spark.createDataFrame([], schema)
        return frame.drop("slice") if slices is None else frame

    # -- frames ------------------------------------------------------------------

    def _order_rows(self) -> DataFrame:
        if self._measured is not None:
            return self._measured
        measures = order_measures(self._items) if self._measures is None else self._measures
        return self._shop.orders.join(measures, "order_id", "left")

    def _item_rows(self, rows: DataFrame) -> DataFrame:
        return rows.join(_carried(self._shop.orders), "order_id", "left")

    @cached_property
    def orders(self) -> DataFrame:
        self._first("orders", self._order_rows())
        return self._read("orders")

    @cached_property
    def items(self) -> DataFrame:
        if self._lines is None:
            self._first("items", self._item_rows(self._items))
        else:
            self._first("items", self._item_rows(self._lines), self._unpack)
        return self._read("items")

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self._root}/{name}/{uuid.uuid4().hex[:12]}"
        with sized(self._spark, self._partitions):
            df.write.parquet(path)
        return self._spark.read.parquet(path).select(*df.columns)

    @property
    def products(self) -> DataFrame:
        return self._shop.products

    @property
    def users(self) -> DataFrame:
        return self._shop.users

    @cached_property
    def categories(self) -> DataFrame:
        return self._put("categories", self._shop.categories)

    @cached_property
    def product_categories(self) -> DataFrame:
        return self._put("product_categories", self._shop.product_categories)

    @cached_property
    def coupons(self) -> DataFrame:
        return self._put("coupons", self._coupons(self.items) if self._coupons else self._shop.coupons)

    @cached_property
    def signups(self) -> DataFrame:
        return self._put("signups", self._shop.signups)

    # -- upkeep ------------------------------------------------------------------

    def refresh(self, orders: DataFrame | None = None, items: DataFrame | None = None, shop: Shop | None = None) -> list[str]:
        """Take in changed and new rows; returns the slices written (``table/number``).

        ``orders``: the newest row of each changed or new order, columns of the model.
        ``items``: all items of each order whose items changed; orders without a row
        here keep theirs.  ``shop``: the source model as it is now, whose other frames
        (products, categories, coupons, users, sign-ups) are stored anew when read."""
        old_orders, old_items = self.orders, self.items
        base = [c for c in old_orders.columns if c not in MEASURES]
        plain = [c for c in old_items.columns if c not in CARRIED]
        none = lambda df, columns: df.select(*columns).limit(0)
        orders = none(old_orders, base) if orders is None else orders.select(*base)
        items = none(old_items, plain) if items is None else items.select(*plain)
        ids = orders.select("order_id").union(items.select("order_id")).distinct()

        # the changed orders and their items as they are now
        new_orders = orders.unionByName(old_orders.select(*base).join(ids, "order_id", "left_semi").join(
            orders.select("order_id"), "order_id", "left_anti").select(*base))
        new_items = items.unionByName(old_items.select(*plain).join(ids, "order_id", "left_semi").join(
            items.select("order_id"), "order_id", "left_anti").select(*plain))
        version = self._next()
        rows = {
            "orders": new_orders.join(order_measures(new_items), "order_id", "left").select(*_as(old_orders)),
            "items": new_items.join(_carried(new_orders), "order_id", "left").select(*_as(old_items))}
        tables, written = {}, []
        for name, changed in rows.items():
            tables[name], touched = self._merge(name, changed, ids, version)
            written += [f"{name}/{s}" for s in touched]
        if not self._publish(**tables):
            raise RuntimeError(f"another writer has changed {self._root}: refresh again")
        if shop is not None:
            self._shop, self._items, self._lines, self._measures, self._measured = shop, shop.items, None, None, None
        gone = ("orders", "items", "coupons") + (() if shop is None else ("categories", "product_categories", "signups"))
        for name in gone:
            self.__dict__.pop(name, None)
        return written

    def _merge(self, name: str, changed: DataFrame, ids: DataFrame, version: str) -> tuple[dict, list[str]]:
        """The manifest entry of ``name`` with the rows of the orders ``ids`` replaced
        by ``changed``, and the slices written."""
        table, by = self._manifest[name], SORTED_BY[name]
        slices: dict[str, dict] = table["slices"]
        numbers = sorted(slices, key=int)
        later = int(numbers[-1]) + 1 if numbers else 0
        # the first slice that ends at the row's time or after it; past all, a new one
        ends = sorted((e["hi"], int(s)) for s, e in slices.items() if e["hi"] is not None)
        times = F.split(F.lit("|".join(hi for hi, _ in ends)), r"\|").cast("array<timestamp_ntz>") if ends else F.array()
        earlier = F.size(F.filter(times, lambda hi: hi < F.col(by)))
        place = F.element_at(F.array(*[F.lit(s) for _, s in ends], F.lit(later)), earlier + 1)
        first = int(numbers[0]) if numbers else 0
        placed = changed.withColumn("slice", F.when(F.col(by).isNull(), F.lit(first)).otherwise(place))
        stored = self._read(name, numbers)
        held = stored.join(ids, "order_id", "left_semi").select("slice").union(placed.select("slice")).distinct()
        touched = sorted(str(r["slice"]) for r in held.collect())  # at most one a slice
        rewritten = [s for s in touched if s in slices]
        if len(slices) + (str(later) in touched) > 2 * max(table["first"], 1):
            whole = self._read(name).join(ids, "order_id", "left_anti").select(*changed.columns).unionByName(changed)
            fresh = self._write(name, self._sliced(name, whole), version)
            return {**table, "slices": fresh, "first": len(fresh)}, sorted(fresh)
        kept = self._read(name, rewritten).join(ids, "order_id", "left_anti").select(*placed.columns)
        out = kept.unionByName(placed).repartitionByRange(max(len(touched), 1), "slice", by, "order_id")
        fresh = self._write(name, out.sortWithinPartitions("slice", by, "order_id"), version) if touched else {}
        rest = {s: e for s, e in slices.items() if s not in touched}
        return {**table, "slices": {**rest, **fresh}}, touched

    def drop_old(self) -> int:
        """Delete the slices that the current manifest does not name, when no report
        still reads an earlier version; returns how many folders went."""
        fs, path = file_system(self._spark, self._root)
        gone = 0
        for name, table in self._manifest.items():
            current = {(str(e["v"]), s) for s, e in table["slices"].items()}
            for version in fs.listStatus(path(f"{self._root}/{name}")):
                for part in fs.listStatus(version.getPath()):
                    v, s = version.getPath().getName(), part.getPath().getName()
                    if s.startswith("slice=") and (v.removeprefix("v="), s.removeprefix("slice=")) not in current:
                        gone += bool(fs.delete(part.getPath(), True))
        return gone


def store_shop(shop: Shop, folder: str, partitions: int, items: DataFrame | None = None,
               coupons: Callable[[DataFrame], DataFrame] | None = None, lines: DataFrame | None = None,
               unpack: Unpack | None = None, measures: DataFrame | None = None, measured: DataFrame | None = None) -> StoredShop:
    """``shop`` as tables under ``folder``, each written at its first use.
    ``items`` may give the same item rows computed another way, ``lines`` and ``unpack``
    the same packed (see ``StoredShop``; e.g. ``star.items_of_lines``), ``measures``
    their sums per order, ``measured`` the orders with these, ``coupons`` the coupon frame
    from the stored items."""
    return StoredShop(shop, folder, partitions, items, coupons, lines, unpack, measures, measured)
