"""Report 10: low-stock and out-of-stock lists.

Candidates are the union of four product sets (ids are unique, so the union
is one OR predicate over the product dimension — a single filtered scan):

1. published simple products with managed stock, stock <= low;
2. published variations with a non-blank stock <= low;
3. published variable products with managed stock, stock <= low;
4. published products flagged ``outofstock``.

"stock <= low" is MySQL's CAST(text AS SIGNED).  The low list then keeps
candidates whose integer stock is above the no-stock threshold and which
are not flagged; the out list keeps flagged ones and those whose raw stock
text is not above the threshold (PHP comparison of text with a number), so
a stock of 0.5 with threshold 0 is in neither list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions.numbers import mysql_number, mysql_signed, php_int
from ..model import DEFAULT, Params, Shop

# Fixed value: PHP's is_numeric shape (leading/trailing blanks allowed).
PHP_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def php_greater(text: Column, number: int) -> Column:
    """PHP 8 ``$text > $number``: numeric text compares as a number, other
    text compares with the number's decimal string."""
    numeric = text.rlike(PHP_NUMERIC)
    return F.when(numeric, F.trim(text).try_cast("double") > F.lit(float(number))).otherwise(
        text > F.lit(str(number)))


def stock_candidates(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    p = shop.products
    low = params.low_stock
    signed = mysql_signed(F.col("stock"))
    has_stock = F.col("stock").isNotNull()
    product = F.col("post_type") == "product"
    managed = product & (F.col("manage_stock") == "yes") & has_stock & (signed <= low)
    simple_or_variable = managed & F.col("product_type").isin("simple", "variable")
    variation = ((F.col("post_type") == "product_variation") & has_stock
                 & (F.col("stock") != "") & (signed <= low))
    flagged = product & (F.col("stock_status") == "outofstock")
    cand = p.filter((F.col("post_status") == "publish") & (simple_or_variable | variation | flagged))
    cand = cand.select(
        "product_id",
        F.when(product, F.col("product_id")).otherwise(F.col("parent_id")).alias("edit_id"),
        F.coalesce(F.col("stock"), F.lit("")).alias("stock"), "sku", "title",
        flagged.alias("flagged"))
    return H.apply(hooks, "stock.candidates", cand)


def low_stock(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(product_id, edit_id, stock bigint, sku, title)."""
    c = stock_candidates(shop, params, hooks)
    stock_int = php_int(mysql_number(F.col("stock")))
    return c.filter(~F.col("flagged") & (stock_int > params.no_stock)).select(
        "product_id", "edit_id", stock_int.alias("stock"), "sku", "title")


def out_of_stock(shop: Shop, params: Params = DEFAULT, hooks=None) -> DataFrame:
    """(product_id, edit_id, stock text, marked, sku, title); ``marked`` is a
    blank stock ("marked out of stock")."""
    c = stock_candidates(shop, params, hooks)
    keep = F.col("flagged") | ~php_greater(F.col("stock"), params.no_stock)
    return c.filter(keep).select("product_id", "edit_id", "stock", (F.col("stock") == "").alias("marked"),
                                 "sku", "title")
