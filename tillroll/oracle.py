"""DuckDB SQL of the shop model (the independent oracle).

The same star -> shop rules as ``tillroll.sources.star``, written as SQL
common table expressions over the driver's views (orders, lineitem, part,
customer, events).  ``with_model(names, body)`` prefixes a query with the
CTEs it needs.  Nothing here imports Spark.
"""

from __future__ import annotations

MODEL_CTES = {
    "order_money": """
order_money AS (
  SELECT l_orderkey AS money_order_id,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS order_tax,
         CAST(COALESCE(SUM(CASE WHEN l_discount > 0
                  THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) END), 0)
              AS DECIMAL(18,4)) AS cart_discount
  FROM lineitem GROUP BY l_orderkey)""",
    "order_fact": """
order_core AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 50 = 7 THEN 'shop_order_refund' ELSE 'shop_order' END AS post_type,
         CASE o_orderstatus WHEN 'F' THEN 'wc-completed' WHEN 'O' THEN 'wc-processing'
                            WHEN 'P' THEN 'wc-on-hold' END AS status,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created,
         CAST(o_totalprice AS DECIMAL(18,4)) AS total,
         CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 25 WHEN '2' THEN 15 WHEN '3' THEN 10
                   WHEN '4' THEN 7.5 ELSE 5 END AS DECIMAL(18,4)) AS shipping,
         CASE WHEN o_custkey % 10 = 0 THEN CAST(0 AS BIGINT) ELSE o_custkey END AS customer_id
  FROM orders),
order_fact AS (
  SELECT c.order_id, c.post_type, c.status, c.created, c.total, c.shipping,
         COALESCE(m.order_tax, CAST(0 AS DECIMAL(18,4))) AS order_tax,
         CAST(c.shipping * CAST(0.08 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS shipping_tax,
         CAST(0 AS DECIMAL(18,4)) AS order_discount,
         COALESCE(m.cart_discount, CAST(0 AS DECIMAL(18,4))) AS cart_discount,
         c.customer_id
  FROM order_core c LEFT JOIN order_money m ON c.order_id = m.money_order_id)""",
    "item_fact": """
item_fact AS (
  SELECT l_orderkey AS order_id, 'line_item' AS item_type, CAST(NULL AS VARCHAR) AS item_name,
         l_partkey AS product_id,
         CAST(CASE WHEN l_orderkey % 50 = 7 THEN -CAST(l_quantity AS DECIMAL(18,2))
                   ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS DECIMAL(18,4)) AS qty,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS line_total,
         CAST(NULL AS DECIMAL(18,4)) AS discount_amount, CAST(NULL AS DECIMAL(18,4)) AS tax_amount,
         CAST(NULL AS DECIMAL(18,4)) AS shipping_tax_amount
  FROM lineitem
  UNION ALL
  SELECT l_orderkey, 'coupon',
         'SAVE' || CAST(CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS INTEGER) AS VARCHAR) || '-' || l_returnflag,
         CAST(NULL AS BIGINT), CAST(NULL AS DECIMAL(18,4)), CAST(NULL AS DECIMAL(18,4)),
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,4)),
         CAST(NULL AS DECIMAL(18,4)), CAST(NULL AS DECIMAL(18,4))
  FROM lineitem WHERE l_discount > 0
  UNION ALL
  SELECT l_orderkey, 'tax',
         'VAT' || CAST(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INTEGER) AS VARCHAR),
         CAST(NULL AS BIGINT), CAST(NULL AS DECIMAL(18,4)), CAST(NULL AS DECIMAL(18,4)),
         CAST(NULL AS DECIMAL(18,4)),
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,4)),
         CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,4))
  FROM lineitem WHERE l_tax > 0)""",
    "product_dim": """
product_dim AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 7 = 3 THEN p_partkey - 1 END AS parent_id,
         CASE WHEN p_partkey % 7 = 3 THEN 'product_variation' ELSE 'product' END AS post_type,
         'publish' AS post_status,
         p_name AS title,
         CASE WHEN p_partkey % 2 = 0 THEN 'SKU' || CAST(p_partkey AS VARCHAR) END AS sku,
         CASE WHEN p_partkey % 7 = 3 THEN NULL
              WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'variable' ELSE 'simple' END AS product_type,
         CASE WHEN p_partkey % 4 <> 0 THEN 'yes' ELSE 'no' END AS manage_stock,
         CASE WHEN p_size % 13 = 0 THEN '' ELSE CAST(p_size - 5 AS VARCHAR) END AS stock,
         CASE WHEN p_size % 10 = 0 THEN 'outofstock' ELSE 'instock' END AS stock_status
  FROM part)""",
    "category_dim": """
child_terms AS (
  SELECT p_type, p_brand, MIN(p_partkey) + 2000000 AS term_id FROM part GROUP BY p_type, p_brand),
root_terms AS (
  SELECT p_type, MIN(p_partkey) + 1000000 AS root_id FROM part GROUP BY p_type),
category_dim AS (
  SELECT root_id AS term_id, CAST(0 AS BIGINT) AS parent_id, p_type AS name FROM root_terms
  UNION ALL
  SELECT c.term_id, r.root_id, c.p_type || '/' || c.p_brand
  FROM child_terms c JOIN root_terms r ON c.p_type = r.p_type),
product_category AS (
  SELECT p.p_partkey AS product_id, c.term_id
  FROM part p JOIN child_terms c ON p.p_type = c.p_type AND p.p_brand = c.p_brand)""",
    "coupon_dim": """
coupon_names AS (
  SELECT DISTINCT item_name,
         CAST(regexp_extract(item_name, '^SAVE(\\d+)-', 1) AS INTEGER) AS pct,
         ascii(regexp_extract(item_name, '-(.)$', 1)) AS flag
  FROM item_fact WHERE item_type = 'coupon'),
coupon_dim AS (
  SELECT CAST(1000 + pct * 100 + flag AS BIGINT) AS coupon_id, item_name AS title, 'publish' AS post_status
  FROM coupon_names WHERE pct % 2 = 1
  UNION ALL
  SELECT CAST(1000 + pct * 100 + flag - 50 AS BIGINT), item_name, 'trash'
  FROM coupon_names WHERE pct % 3 = 0)""",
    "user_dim": """
user_dim AS (
  SELECT c_custkey AS user_id, 'customer' AS role, CAST(NULL AS TIMESTAMP) AS user_registered FROM customer),
signup_dim AS (
  SELECT user_id, 'customer' AS role, ts AS user_registered FROM events WHERE event_type = 'signup'
  QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY ts, user_id) = 1)""",
}

DEPENDS = {"order_fact": ["order_money"], "coupon_dim": ["item_fact"]}
ORDER = ["order_money", "order_fact", "item_fact", "product_dim", "category_dim", "coupon_dim", "user_dim"]


def with_model(names: list[str], body: str, extra: str = "", recursive: bool = False) -> str:
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for d in DEPENDS.get(n, []):
            add(d)

    for n in names:
        add(n)
    ctes = [MODEL_CTES[n].strip() for n in ORDER if n in need]
    if extra:
        ctes.append(extra.strip())
    prefix = "WITH RECURSIVE " if recursive else "WITH "
    return prefix + ",\n".join(ctes) + "\n" + body.strip()
