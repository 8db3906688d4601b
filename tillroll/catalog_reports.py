"""Registrations: one entry per report / operator key of the survey.

Each Spark entry is a thin call into ``tillroll.plans``; each oracle is the
DuckDB text of the same result.  Parameters come from ``model.DEFAULT``.
"""

from __future__ import annotations

from .catalog import (COMPLETED_ORDERS, IN_RANGE, IN_YEAR, P, absint_sql, pct2_sql,
                      register, round2_sql, shop)
from .oracle import with_model
from .plans import categories, coupons, customers, daily, monthly, products, stock, taxes, totals

# --------------------------------------------------------------------------
# 1. totals

_TOTALS_BODY = f"""
, a AS (SELECT SUM(total) AS s, COUNT(*) AS n,
               SUM(COALESCE(order_discount, 0) + COALESCE(cart_discount, 0)) AS d,
               SUM(shipping) AS sh
        FROM order_fact WHERE {COMPLETED_ORDERS}),
  q AS (SELECT SUM(i.qty) AS q FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
        WHERE f.status = 'wc-completed' AND i.item_type = 'line_item'),
  t AS (
SELECT CAST(COALESCE(a.s, 0) AS DOUBLE) AS total_sales,
       CAST(a.n AS BIGINT) AS total_orders,
       {absint_sql('q.q')} AS total_items,
       CASE WHEN a.n > 0 THEN CAST(COALESCE(a.s, 0) AS DOUBLE) / CAST(a.n AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS average_total,
       CASE WHEN a.n > 0 THEN {round2_sql(absint_sql('q.q'), 'a.n')} ELSE CAST(0 AS DOUBLE) END AS average_items,
       CAST(COALESCE(a.d, 0) AS DOUBLE) AS discounts,
       CAST(COALESCE(a.sh, 0) AS DOUBLE) AS shippings
FROM a, q)"""


@register("totals_overview", with_model(["order_fact", "item_fact"], "SELECT * FROM t",
                                      extra=_TOTALS_BODY.lstrip("\n, ")))
def q_totals_overview(spark, sf_dir):
    return totals.totals_overview(shop(spark, sf_dir))


@register("report_rows_totals", with_model(["order_fact", "item_fact"], """
SELECT CAST(ord AS INTEGER) AS ord, metric, value FROM (
  SELECT 1 AS ord, 'total_sales' AS metric, CAST(total_sales AS DOUBLE) AS value FROM t
  UNION ALL SELECT 2, 'total_orders', CAST(total_orders AS DOUBLE) FROM t
  UNION ALL SELECT 3, 'total_items', CAST(total_items AS DOUBLE) FROM t
  UNION ALL SELECT 4, 'average_total', CAST(average_total AS DOUBLE) FROM t
  UNION ALL SELECT 5, 'average_items', CAST(average_items AS DOUBLE) FROM t
  UNION ALL SELECT 6, 'discounts', CAST(discounts AS DOUBLE) FROM t
  UNION ALL SELECT 7, 'shippings', CAST(shippings AS DOUBLE) FROM t)""",
    extra=_TOTALS_BODY.lstrip("\n, ")))
def q_report_rows_totals(spark, sf_dir):
    return totals.report_rows(totals.totals_overview(shop(spark, sf_dir)))


# --------------------------------------------------------------------------
# 2. daily

_RANGE_ORDERS = f"""
o AS (SELECT order_id, created, total FROM order_fact WHERE {COMPLETED_ORDERS} AND {IN_RANGE})"""


@register("daily_sales", with_model(["order_fact"], f"""
SELECT COALESCE(s.day, d.day) AS day, CAST(COALESCE(d.orders, 0) AS BIGINT) AS orders,
       CAST(COALESCE(d.amount, 0) AS DOUBLE) AS amount
FROM spine s FULL JOIN d ON s.day = d.day""", extra=_RANGE_ORDERS + """,
d AS (SELECT CAST(created AS DATE) AS day, COUNT(*) AS orders, SUM(total) AS amount FROM o GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(DATE '1998-03-01', DATE '1998-03-30', INTERVAL 1 DAY)) AS DATE) AS day)"""))
def q_daily_sales(spark, sf_dir):
    return daily.daily_sales(shop(spark, sf_dir), P)


@register("daily_sales_summary", with_model(["order_fact", "item_fact"], f"""
SELECT CAST(COALESCE(SUM(total), 0) AS DOUBLE) AS total_sales,
       CAST(COUNT(*) AS BIGINT) AS total_orders,
       CAST(COALESCE(SUM({absint_sql('qty')}), 0) AS BIGINT) AS total_items,
       CASE WHEN COUNT(*) > 0 THEN CAST(COALESCE(SUM(total), 0) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS average_total,
       CASE WHEN COUNT(*) > 0 THEN {round2_sql(f"COALESCE(SUM({absint_sql('qty')}), 0)", 'COUNT(*)')}
            ELSE CAST(0 AS DOUBLE) END AS average_items
FROM po""", extra=_RANGE_ORDERS + """,
po AS (SELECT o.order_id, o.total, SUM(i.qty) AS qty
       FROM o LEFT JOIN item_fact i ON i.order_id = o.order_id AND i.item_type = 'line_item'
       GROUP BY o.order_id, o.total)"""))
def q_daily_sales_summary(spark, sf_dir):
    return daily.daily_sales_summary(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# 3. monthly

_MONTHLY = f"""
om AS (SELECT CAST(month(created) AS INTEGER) AS m, COUNT(*) AS n, SUM(total) AS s
       FROM order_fact WHERE {COMPLETED_ORDERS} AND {IN_YEAR} GROUP BY 1),
im AS (SELECT CAST(month(f.created) AS INTEGER) AS m, SUM(i.qty) AS q
       FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
       WHERE f.status = 'wc-completed' AND f.{IN_YEAR} AND i.item_type = 'line_item' GROUP BY 1),
spine AS (SELECT CAST(m AS INTEGER) AS month, make_date({P.year}, CAST(m AS INTEGER), 1) AS month_start
          FROM range(1, 10) t(m)),
monthly AS (
  SELECT s.month_start, CAST(COALESCE(om.n, 0) AS BIGINT) AS orders, COALESCE(om.s, 0) AS sales_dec,
         {absint_sql('im.q')} AS items
  FROM spine s LEFT JOIN om ON om.m = s.month LEFT JOIN im ON im.m = s.month)"""


@register("monthly_sales", with_model(["order_fact", "item_fact"], """
SELECT month_start, orders, CAST(sales_dec AS DOUBLE) AS sales, items FROM monthly""", extra=_MONTHLY))
def q_monthly_sales(spark, sf_dir):
    return monthly.monthly_sales(shop(spark, sf_dir), P)


@register("monthly_sales_summary", with_model(["order_fact", "item_fact"], f"""
SELECT CASE WHEN s > 0 THEN CAST(s AS DOUBLE) END AS total_sales,
       CASE WHEN n > 0 THEN n END AS total_orders,
       CASE WHEN n > 0 THEN q END AS total_items,
       CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / CAST(n AS DOUBLE) END AS average_total,
       CASE WHEN n > 0 THEN {round2_sql('q', 'n')} END AS average_items
FROM (SELECT SUM(sales_dec) AS s, CAST(SUM(orders) AS BIGINT) AS n, CAST(SUM(items) AS BIGINT) AS q
      FROM monthly) t""", extra=_MONTHLY))
def q_monthly_sales_summary(spark, sf_dir):
    return monthly.monthly_sales_summary(shop(spark, sf_dir), P)


@register("report_years", with_model(["order_fact"], f"""
SELECT CAST(unnest(range(COALESCE(fy, {P.now.year}), {P.now.year + 1})) AS INTEGER) AS year
FROM (SELECT year(MIN(created)) AS fy FROM order_fact WHERE created IS NOT NULL) t"""))
def q_report_years(spark, sf_dir):
    return monthly.report_years(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# 4-6. products

_RANGE_LINES = f"""
ro AS (SELECT order_id FROM order_fact WHERE {COMPLETED_ORDERS} AND {IN_RANGE}),
rl AS (SELECT i.product_id, i.qty, i.line_total FROM item_fact i JOIN ro ON i.order_id = ro.order_id
       WHERE i.item_type = 'line_item')"""


def _top_sql(measure: str, expr: str, bar: str) -> str:
    return with_model(["order_fact", "item_fact", "product_dim"], f"""
SELECT CAST(t.rk AS INTEGER) AS rank, t.product_id, p.title, CAST(t.{measure} AS DOUBLE) AS {measure},
       {bar} AS bar_pct
FROM top t LEFT JOIN product_dim p ON p.product_id = t.product_id
CROSS JOIN (SELECT MAX({measure}) AS mx FROM top WHERE rk <= 25) m
WHERE t.rk <= 25""", extra=_RANGE_LINES + f""",
pp AS (SELECT product_id, SUM({expr}) AS {measure} FROM rl GROUP BY product_id),
top AS (SELECT product_id, {measure},
               ROW_NUMBER() OVER (ORDER BY {measure} DESC, CAST(product_id AS VARCHAR) DESC) AS rk FROM pp)""")


@register("top_sellers", _top_sql(
    "quantity", "qty",
    "CASE WHEN t.quantity > 0 THEN CAST(t.quantity AS DOUBLE) / NULLIF(CAST(m.mx AS DOUBLE), 0) * 100 "
    "ELSE CAST(0 AS DOUBLE) END"))
def q_top_sellers(spark, sf_dir):
    return products.top_sellers(shop(spark, sf_dir), P)


@register("top_earners", _top_sql(
    "line_total", "line_total",
    "CASE WHEN t.line_total > 0 THEN CAST(round(t.line_total, 0) AS DOUBLE) / "
    "NULLIF(CAST(round(m.mx, 0) AS DOUBLE), 0) * 100 ELSE CAST(0 AS DOUBLE) END"))
def q_top_earners(spark, sf_dir):
    return products.top_earners(shop(spark, sf_dir), P)


_IDS = ", ".join(str(i) for i in P.products)


@register("product_sales_monthly", with_model(["order_fact", "item_fact", "product_dim"], """
SELECT m.month, CAST(m.q AS DOUBLE) AS quantity, CAST(m.t AS DOUBLE) AS line_total,
       CASE WHEN m.q > 0 THEN CAST(round(m.q, 0) AS DOUBLE) / NULLIF(CAST(round(x.mq, 0) AS DOUBLE), 0) * 100
            ELSE CAST(0 AS DOUBLE) END AS qty_bar,
       CASE WHEN m.t > 0 THEN CAST(round(m.t, 0) AS DOUBLE) / NULLIF(CAST(round(x.mt, 0) AS DOUBLE), 0) * 100
            ELSE CAST(0 AS DOUBLE) END AS total_bar
FROM (SELECT month, SUM(q) AS q, SUM(t) AS t FROM run GROUP BY month) m
CROSS JOIN (SELECT GREATEST(COALESCE(MAX(rq), 0), 0) AS mq, GREATEST(COALESCE(MAX(rt), 0), 0) AS mt FROM run) x""",
    extra=f"""
ids AS (SELECT product_id FROM product_dim WHERE parent_id IN ({_IDS})
        UNION SELECT CAST(unnest([{_IDS}]) AS BIGINT)),
po AS (SELECT i.order_id, f.created, SUM(i.qty) AS q, SUM(i.line_total) AS t
       FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
       WHERE i.item_type = 'line_item' AND i.product_id IN (SELECT product_id FROM ids)
         AND f.{COMPLETED_ORDERS}
       GROUP BY i.order_id, f.created
       HAVING NOT (SUM(i.qty) = 0 AND SUM(i.line_total) = 0)),
run AS (SELECT strftime(created, '%Y%m') AS month, q, t,
               SUM(q) OVER (PARTITION BY strftime(created, '%Y%m') ORDER BY created, order_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rq,
               SUM(t) OVER (PARTITION BY strftime(created, '%Y%m') ORDER BY created, order_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rt
        FROM po)"""))
def q_product_sales_monthly(spark, sf_dir):
    return products.product_sales_monthly(shop(spark, sf_dir), P)


@register("product_children", with_model(["product_dim"], """
SELECT p.product_id AS parent_id, p.title AS parent_title, c.product_id AS child_id, c.post_type AS child_type
FROM product_dim c JOIN product_dim p ON c.parent_id = p.product_id"""))
def q_product_children(spark, sf_dir):
    return products.product_children(shop(spark, sf_dir))


# --------------------------------------------------------------------------
# 7-8. coupons

_COUPON_ITEMS = f"""
ci AS (SELECT i.order_id, i.item_name AS coupon, i.discount_amount, f.created
       FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
       WHERE f.status = 'wc-completed' AND i.item_type = 'coupon' AND i.discount_amount IS NOT NULL),
lk AS (SELECT title AS coupon, MIN(coupon_id) AS coupon_id FROM coupon_dim
       WHERE post_status = 'publish' GROUP BY title)"""
_COUPON_MODEL = ["order_fact", "item_fact", "coupon_dim"]


@register("coupon_usage_overview", with_model(_COUPON_MODEL, f"""
SELECT CAST(a.n AS BIGINT) AS order_count,
       CASE WHEN b.c > 0 THEN CAST(b.c AS BIGINT) END AS coupon_orders,
       CASE WHEN b.c > 0 THEN {pct2_sql('b.c', 'a.n')} END AS coupon_pct,
       CASE WHEN b.d > 0 THEN CAST(b.d AS DOUBLE) END AS total_discount
FROM (SELECT COUNT(DISTINCT order_id) AS n FROM order_fact
      WHERE status = 'wc-completed' AND {IN_RANGE}) a
CROSS JOIN (SELECT COUNT(DISTINCT order_id) AS c, SUM(discount_amount) AS d FROM ci WHERE {IN_RANGE}) b""",
    extra=_COUPON_ITEMS))
def q_coupon_usage_overview(spark, sf_dir):
    return coupons.coupon_usage_overview(shop(spark, sf_dir), P)


def _coupon_top_sql(measure: str, agg: str, cast: str) -> str:
    return with_model(_COUPON_MODEL, f"""
SELECT CAST(t.rk AS INTEGER) AS rank, t.coupon, CAST(t.{measure} AS {cast}) AS {measure}, lk.coupon_id
FROM (SELECT coupon, {measure}, ROW_NUMBER() OVER (ORDER BY {measure} DESC, coupon ASC) AS rk
      FROM (SELECT coupon, {agg} AS {measure} FROM ci WHERE coupon <> '' AND {IN_RANGE} GROUP BY coupon) p) t
LEFT JOIN lk ON lk.coupon = t.coupon
WHERE t.rk <= 15""", extra=_COUPON_ITEMS)


@register("coupons_most_used", _coupon_top_sql("uses", "COUNT(*)", "BIGINT"))
def q_coupons_most_used(spark, sf_dir):
    return coupons.coupons_most_used(shop(spark, sf_dir), P)


@register("coupons_greatest_discount", _coupon_top_sql("amount", "SUM(discount_amount)", "DOUBLE"))
def q_coupons_greatest_discount(spark, sf_dir):
    return coupons.coupons_greatest_discount(shop(spark, sf_dir), P)


@register("used_coupons", with_model(_COUPON_MODEL, """
SELECT DISTINCT coupon FROM ci WHERE coupon <> ''""", extra=_COUPON_ITEMS))
def q_used_coupons(spark, sf_dir):
    return coupons.used_coupons(shop(spark, sf_dir))


@register("coupon_lookup", with_model(_COUPON_MODEL, """
SELECT u.coupon, lk.coupon_id FROM (SELECT DISTINCT coupon FROM ci WHERE coupon <> '') u
LEFT JOIN lk ON lk.coupon = u.coupon""", extra=_COUPON_ITEMS))
def q_coupon_lookup(spark, sf_dir):
    return coupons.used_coupon_lookup(shop(spark, sf_dir))


_COUPON_YEAR = _COUPON_ITEMS + f""",
cells AS (SELECT coupon, CAST(month(created) AS INTEGER) AS month, SUM(discount_amount) AS d
          FROM ci WHERE coupon <> '' AND {IN_YEAR} GROUP BY 1, 2),
crow AS (SELECT coupon, SUM(d) AS d FROM cells GROUP BY coupon),
months AS (SELECT CAST(m AS INTEGER) AS month FROM range(1, 10) t(m))"""


@register("coupon_discounts_monthly", with_model(_COUPON_MODEL, """
SELECT r.coupon, m.month, CAST(COALESCE(c.d, 0) AS DOUBLE) AS discount
FROM crow r CROSS JOIN months m LEFT JOIN cells c ON c.coupon = r.coupon AND c.month = m.month
UNION ALL SELECT coupon, CAST(NULL AS INTEGER), CAST(d AS DOUBLE) FROM crow
UNION ALL SELECT CAST(NULL AS VARCHAR), month, CAST(d AS DOUBLE) FROM cols
UNION ALL SELECT CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(COALESCE(SUM(d), 0) AS DOUBLE) FROM cols""",
    extra=_COUPON_YEAR + """,
cols AS (SELECT m.month, COALESCE(SUM(c.d), 0) AS d FROM months m LEFT JOIN cells c ON c.month = m.month
         GROUP BY m.month)"""))
def q_coupon_discounts_monthly(spark, sf_dir):
    return coupons.coupon_discounts_monthly(shop(spark, sf_dir), P)


def _stats_sql(rows: str, name: str, pair_null: bool, shown_when_many: bool = False) -> str:
    two = "WHEN s.n = 2 THEN NULL" if pair_null else ""
    many = "s.n > 1" if shown_when_many else "TRUE"  # worst/average/median only when n > 1
    return f"""
SELECT (SELECT {name} FROM {rows} ORDER BY total DESC, {name} ASC LIMIT 1) AS top,
       CAST(s.mx AS DOUBLE) AS top_total,
       CASE WHEN {many} THEN (SELECT {name} FROM {rows} ORDER BY total ASC, {name} ASC LIMIT 1) END AS worst,
       CASE WHEN {many} THEN CAST(s.mn AS DOUBLE) END AS worst_total,
       CASE WHEN {many} THEN CAST(s.sm AS DOUBLE) / CAST(s.n AS DOUBLE) END AS average,
       CASE {two} WHEN NOT ({many}) THEN NULL
            WHEN s.n % 2 = 1 THEN (CAST((SELECT total FROM ranked WHERE rn = (s.n + 1) // 2) AS DOUBLE)
                                   + COALESCE(CAST((SELECT total FROM ranked WHERE rn = (s.n + 3) // 2) AS DOUBLE), 0))
                                  / CAST(2 AS DOUBLE)
            ELSE CAST((SELECT total FROM ranked WHERE rn = s.n // 2 + 1) AS DOUBLE) END AS median
FROM (SELECT COUNT(*) AS n, MAX(total) AS mx, MIN(total) AS mn, SUM(total) AS sm FROM {rows}) s"""


@register("coupon_discounts_stats", with_model(_COUPON_MODEL, _stats_sql("crt", "coupon", True) + """
WHERE s.n > 1""", extra=_COUPON_YEAR + """,
crt AS (SELECT coupon, d AS total FROM crow),
ranked AS (SELECT total, ROW_NUMBER() OVER (ORDER BY total, coupon) AS rn FROM crt)"""))
def q_coupon_discounts_stats(spark, sf_dir):
    return coupons.coupon_discounts_stats(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# 9. customers

@register("customer_guest_overview", with_model(["order_fact", "user_dim"], f"""
SELECT CASE WHEN u.n > 0 THEN CAST(u.n AS BIGINT) END AS total_customers,
       CASE WHEN c.s > 0 THEN CAST(c.s AS DOUBLE) END AS total_customer_sales,
       CASE WHEN g.s > 0 THEN CAST(g.s AS DOUBLE) END AS total_guest_sales,
       CASE WHEN c.n > 0 THEN CAST(c.n AS BIGINT) END AS total_customer_orders,
       CASE WHEN g.n > 0 THEN CAST(g.n AS BIGINT) END AS total_guest_orders,
       CASE WHEN c.n > 0 AND u.n > 0 THEN {round2_sql('c.n', 'u.n')} END AS orders_per_customer
FROM (SELECT COUNT(*) AS n FROM user_dim WHERE role = 'customer') u
CROSS JOIN (SELECT SUM(total) AS s, COUNT(*) AS n FROM order_fact
            WHERE {COMPLETED_ORDERS} AND order_id IN (SELECT order_id FROM order_fact WHERE customer_id > 0)) c
CROSS JOIN (SELECT SUM(total) AS s, COUNT(*) AS n FROM order_fact
            WHERE {COMPLETED_ORDERS} AND order_id IN (SELECT order_id FROM order_fact WHERE customer_id = 0)) g"""))
def q_customer_guest_overview(spark, sf_dir):
    return customers.customer_guest_overview(shop(spark, sf_dir), P)


@register("customer_signups_daily", with_model(["user_dim"], """
SELECT COALESCE(s.day, d.day) AS day, CAST(COALESCE(d.n, 0) AS BIGINT) AS signups
FROM spine s FULL JOIN d ON s.day = d.day""", extra="""
d AS (SELECT CAST(user_registered AS DATE) AS day, COUNT(*) AS n FROM signup_dim
      WHERE role = 'customer' AND user_registered > TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)"""))
def q_customer_signups_daily(spark, sf_dir):
    return customers.customer_signups_daily(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# 10. stock

_SIGNED = "COALESCE(TRY_CAST(regexp_extract(stock, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0)"
_NUMBER = ("COALESCE(TRY_CAST(regexp_extract(COALESCE(stock, ''), "
           "'^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE), 0)")
_STOCK = f"""
cand AS (
  SELECT product_id,
         CASE WHEN post_type = 'product' THEN product_id ELSE parent_id END AS edit_id,
         COALESCE(stock, '') AS stock, sku, title,
         (post_type = 'product' AND stock_status = 'outofstock') AS flagged
  FROM product_dim
  WHERE post_status = 'publish' AND (
        (post_type = 'product' AND manage_stock = 'yes' AND stock IS NOT NULL AND {_SIGNED} <= {P.low_stock}
         AND product_type IN ('simple', 'variable'))
     OR (post_type = 'product_variation' AND stock IS NOT NULL AND stock <> '' AND {_SIGNED} <= {P.low_stock})
     OR (post_type = 'product' AND stock_status = 'outofstock')))"""


@register("low_stock", with_model(["product_dim"], f"""
SELECT product_id, edit_id, CAST(trunc({_NUMBER}) AS BIGINT) AS stock, sku, title
FROM cand WHERE NOT flagged AND CAST(trunc({_NUMBER}) AS BIGINT) > {P.no_stock}""", extra=_STOCK))
def q_low_stock(spark, sf_dir):
    return stock.low_stock(shop(spark, sf_dir), P)


@register("out_of_stock", with_model(["product_dim"], f"""
SELECT product_id, edit_id, stock, stock = '' AS marked, sku, title
FROM cand
WHERE flagged OR NOT (CASE WHEN regexp_matches(stock, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                          THEN TRY_CAST(trim(stock) AS DOUBLE) > {P.no_stock}
                          ELSE stock > '{P.no_stock}' END)""", extra=_STOCK))
def q_out_of_stock(spark, sf_dir):
    return stock.out_of_stock(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# 11. taxes

_TAX_MONTHS = f"""
tm AS (SELECT CAST(month(created) AS INTEGER) AS m, SUM(total) AS gross, SUM(shipping) AS shipping,
              SUM(order_tax) AS order_tax, SUM(shipping_tax) AS shipping_tax
       FROM order_fact WHERE {COMPLETED_ORDERS} AND {IN_YEAR} GROUP BY 1),
spine AS (SELECT CAST(m AS INTEGER) AS month, make_date({P.year}, CAST(m AS INTEGER), 1) AS month_start
          FROM range(1, 10) t(m)),
tx AS (SELECT s.month_start, COALESCE(tm.gross, 0) AS gross, COALESCE(tm.shipping, 0) AS shipping,
              COALESCE(tm.order_tax, 0) AS order_tax, COALESCE(tm.shipping_tax, 0) AS shipping_tax
       FROM spine s LEFT JOIN tm ON tm.m = s.month)"""


@register("monthly_taxes", with_model(["order_fact"], """
SELECT month_start, CAST(gross AS DOUBLE) AS gross, CAST(shipping AS DOUBLE) AS shipping,
       CAST(order_tax AS DOUBLE) AS order_tax, CAST(shipping_tax AS DOUBLE) AS shipping_tax,
       CAST(order_tax + shipping_tax AS DOUBLE) AS total_tax,
       CAST(gross - shipping - (order_tax + shipping_tax) AS DOUBLE) AS net
FROM tx""", extra=_TAX_MONTHS))
def q_monthly_taxes(spark, sf_dir):
    return taxes.monthly_taxes(shop(spark, sf_dir), P)


@register("tax_year_summary", with_model(["order_fact"], """
SELECT CASE WHEN ot + st > 0 THEN CAST(ot + st AS DOUBLE) END AS total_tax,
       CASE WHEN ot > 0 THEN CAST(ot AS DOUBLE) END AS product_tax,
       CASE WHEN st > 0 THEN CAST(st AS DOUBLE) END AS shipping_tax,
       CAST(COALESCE(g, 0) AS DOUBLE) AS gross, CAST(COALESCE(sh, 0) AS DOUBLE) AS shipping,
       CAST(COALESCE(g - sh - (ot + st), 0) AS DOUBLE) AS net
FROM (SELECT SUM(gross) AS g, SUM(shipping) AS sh, SUM(order_tax) AS ot, SUM(shipping_tax) AS st FROM tx) t""",
    extra=_TAX_MONTHS))
def q_tax_year_summary(spark, sf_dir):
    return taxes.tax_year_summary(shop(spark, sf_dir), P)


@register("monthly_taxes_by_rate", with_model(["order_fact", "item_fact"], """
SELECT m.month, l.rate, CAST(COALESCE(c.tax, 0) AS DOUBLE) AS tax,
       CAST(COALESCE(c.shipping_tax, 0) AS DOUBLE) AS shipping_tax,
       CAST(COALESCE(c.total_tax, 0) AS DOUBLE) AS total_tax
FROM labels l CROSS JOIN months m LEFT JOIN cells c ON c.rate = l.rate AND c.month = m.month
UNION ALL
SELECT CAST(NULL AS INTEGER), l.rate, CAST(COALESCE(SUM(c.tax), 0) AS DOUBLE),
       CAST(COALESCE(SUM(c.shipping_tax), 0) AS DOUBLE), CAST(COALESCE(SUM(c.total_tax), 0) AS DOUBLE)
FROM labels l LEFT JOIN cells c ON c.rate = l.rate GROUP BY l.rate""", extra=f"""
cells AS (SELECT CAST(month(f.created) AS INTEGER) AS month, i.item_name AS rate,
                 SUM(i.tax_amount) AS tax, SUM(i.shipping_tax_amount) AS shipping_tax,
                 SUM(i.tax_amount + i.shipping_tax_amount) AS total_tax
          FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
          WHERE i.item_type = 'tax' AND i.tax_amount IS NOT NULL AND i.shipping_tax_amount IS NOT NULL
            AND f.{COMPLETED_ORDERS} AND f.{IN_YEAR} AND month(f.created) <= 9
          GROUP BY 1, 2),
labels AS (SELECT DISTINCT rate FROM cells WHERE total_tax > 0 AND rate IS NOT NULL AND rate NOT IN ('', '0')),
months AS (SELECT CAST(m AS INTEGER) AS month FROM range(1, 10) t(m))"""))
def q_monthly_taxes_by_rate(spark, sf_dir):
    return taxes.monthly_taxes_by_rate(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# 12. categories

_NAMES = ", ".join(f"'{n}'" for n in P.category_names)
_CAT = f"""
walk(ancestor_id, term_id, depth) AS (
  SELECT term_id, term_id, 0 FROM category_dim
  UNION ALL
  SELECT w.ancestor_id, c.term_id, w.depth + 1 FROM walk w JOIN category_dim c ON c.parent_id = w.term_id),
chosen AS (SELECT term_id FROM category_dim WHERE name IN ({_NAMES})),
incl AS (SELECT DISTINCT w.term_id FROM walk w JOIN chosen c ON w.ancestor_id = c.term_id),
bridge AS (SELECT DISTINCT w.ancestor_id AS cat, pc.product_id
           FROM walk w JOIN incl i ON w.ancestor_id = i.term_id
           JOIN product_category pc ON pc.term_id = w.term_id),
sales AS (SELECT CAST(month(f.created) AS INTEGER) AS month, i.product_id, SUM(i.line_total) AS s
          FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
          WHERE i.item_type = 'line_item' AND f.{COMPLETED_ORDERS} AND f.{IN_YEAR} AND month(f.created) <= 9
          GROUP BY 1, 2),
cm AS (SELECT b.cat, s.month, SUM(s.s) AS s FROM bridge b JOIN sales s ON s.product_id = b.product_id
       GROUP BY 1, 2),
ct AS (SELECT cat, SUM(s) AS total FROM cm GROUP BY cat HAVING SUM(s) <> 0),
months AS (SELECT CAST(m AS INTEGER) AS month FROM range(1, 10) t(m))"""
_CAT_MODEL = ["order_fact", "item_fact", "category_dim"]


@register("category_sales_monthly", with_model(_CAT_MODEL, """
SELECT c.name AS category, c.parent_id > 0 AS is_child, m.month, CAST(COALESCE(x.s, 0) AS DOUBLE) AS sales
FROM ct JOIN category_dim c ON c.term_id = ct.cat CROSS JOIN months m
LEFT JOIN cm x ON x.cat = ct.cat AND x.month = m.month
UNION ALL
SELECT c.name, c.parent_id > 0, CAST(NULL AS INTEGER), CAST(ct.total AS DOUBLE)
FROM ct JOIN category_dim c ON c.term_id = ct.cat""", extra=_CAT, recursive=True))
def q_category_sales_monthly(spark, sf_dir):
    return categories.category_sales_monthly(shop(spark, sf_dir), P)


@register("category_sales_totals", with_model(_CAT_MODEL, """
SELECT month, CAST(s AS DOUBLE) AS sales FROM mt
UNION ALL SELECT CAST(NULL AS INTEGER), CAST(COALESCE(SUM(s), 0) AS DOUBLE) FROM mt""", extra=_CAT + """,
tops AS (SELECT term_id FROM incl i
         WHERE NOT EXISTS (SELECT 1 FROM walk w JOIN incl a ON a.term_id = w.ancestor_id
                           WHERE w.term_id = i.term_id AND w.depth > 0)),
mt AS (SELECT m.month, COALESCE(SUM(cm.s), 0) AS s
       FROM months m LEFT JOIN cm ON cm.month = m.month AND cm.cat IN (SELECT term_id FROM tops)
       GROUP BY m.month)""", recursive=True))
def q_category_sales_totals(spark, sf_dir):
    return categories.category_sales_totals(shop(spark, sf_dir), P)


@register("category_sales_stats", with_model(_CAT_MODEL, _stats_sql("named", "name", False, shown_when_many=True),
                                           extra=_CAT + """,
named AS (SELECT c.name, ct.total FROM ct JOIN category_dim c ON c.term_id = ct.cat),
ranked AS (SELECT total, ROW_NUMBER() OVER (ORDER BY total, name) AS rn FROM named)""", recursive=True))
def q_category_sales_stats(spark, sf_dir):
    return categories.category_sales_stats(shop(spark, sf_dir), P)


@register("category_closure", with_model(["category_dim"], """
SELECT a.name AS ancestor, w.ancestor_id, t.name AS term, w.term_id, CAST(w.depth AS INTEGER) AS depth
FROM walk w JOIN category_dim a ON a.term_id = w.ancestor_id JOIN category_dim t ON t.term_id = w.term_id""",
    extra="""
walk(ancestor_id, term_id, depth) AS (
  SELECT term_id, term_id, 0 FROM category_dim
  UNION ALL
  SELECT w.ancestor_id, c.term_id, w.depth + 1 FROM walk w JOIN category_dim c ON c.parent_id = w.term_id)""",
    recursive=True))
def q_category_closure(spark, sf_dir):
    return categories.category_closure(shop(spark, sf_dir))


@register("sales_rollup", with_model(_CAT_MODEL, """
SELECT pr.category, CAST(p.month AS INTEGER) AS month, CAST(SUM(p.s) AS DOUBLE) AS sales,
       CAST(GROUPING(pr.category, p.month) AS INTEGER) AS level
FROM per p JOIN pr ON pr.product_id = p.product_id
GROUP BY CUBE (pr.category, p.month)""", extra=f"""
per AS (SELECT CAST(month(f.created) AS INTEGER) AS month, i.product_id, SUM(i.line_total) AS s
        FROM item_fact i JOIN order_fact f ON i.order_id = f.order_id
        WHERE i.item_type = 'line_item' AND f.{COMPLETED_ORDERS} AND f.{IN_YEAR} GROUP BY 1, 2),
up AS (SELECT term_id, term_id AS root_id, parent_id FROM category_dim
       UNION ALL
       SELECT u.term_id, c.term_id, c.parent_id FROM up u JOIN category_dim c ON c.term_id = u.parent_id),
pr AS (SELECT DISTINCT pc.product_id, r.term_id, r.name AS category
       FROM product_category pc JOIN up u ON u.term_id = pc.term_id AND u.parent_id = 0
       JOIN category_dim r ON r.term_id = u.root_id)""", recursive=True))
def q_sales_rollup(spark, sf_dir):
    return categories.sales_rollup(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# operators

from .plans import operators_demo as ops  # noqa: E402



@register("eav_pivot_orders", with_model(["order_fact"], """
SELECT order_id, post_type, status, created, CAST(total AS DOUBLE) AS total, CAST(shipping AS DOUBLE) AS shipping,
       CAST(order_tax AS DOUBLE) AS order_tax, CAST(shipping_tax AS DOUBLE) AS shipping_tax,
       CAST(order_discount AS DOUBLE) AS order_discount, CAST(cart_discount AS DOUBLE) AS cart_discount,
       customer_id
FROM order_fact"""))
def q_eav_pivot_orders(spark, sf_dir):
    return ops.eav_pivot_orders(spark, sf_dir)


@register("eav_repeated_keys", with_model(["order_fact"], """
SELECT order_id, meta_key, CAST(n AS BIGINT) AS n
FROM (SELECT order_id, unnest([{'k': '_order_total', 'n': 2, 'm': 97, 'r': 3, 'have': total IS NOT NULL},
                               {'k': '_customer_user', 'n': 2, 'm': 97, 'r': 3, 'have': customer_id IS NOT NULL},
                               {'k': '_order_tax', 'n': 3, 'm': 389, 'r': 5, 'have': order_tax IS NOT NULL}]) AS p FROM order_fact) t,
     LATERAL (SELECT p.k AS meta_key, p.n AS n, p.have AND order_id * 4 % p.m = p.r AS hit) x
WHERE hit"""))
def q_eav_repeated_keys(spark, sf_dir):
    return ops.eav_repeated_keys(spark, sf_dir)


_NUMBERED = """
numbered AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no
  FROM lineitem),
base AS (SELECT *, line_no * 3 AS bid FROM numbered)"""


@register("eav_pivot_items", f"""
WITH {_NUMBERED.strip()}
SELECT bid AS order_item_id, l_orderkey AS order_id, 'line_item' AS item_type, CAST(NULL AS VARCHAR) AS item_name,
       l_partkey AS product_id,
       CAST(CASE WHEN l_orderkey % 50 = 7 THEN -CAST(l_quantity AS DECIMAL(18,2))
                 ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS DOUBLE) AS qty,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS line_total,
       CAST(NULL AS DOUBLE) AS discount_amount, CAST(NULL AS DOUBLE) AS tax_amount,
       CAST(NULL AS DOUBLE) AS shipping_tax_amount
FROM base
UNION ALL
SELECT bid + 1, l_orderkey, 'coupon',
       'SAVE' || CAST(CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS INTEGER) AS VARCHAR) || '-' || l_returnflag,
       CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DOUBLE),
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM base WHERE l_discount > 0
UNION ALL
SELECT bid + 2, l_orderkey, 'tax', 'VAT' || CAST(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INTEGER) AS VARCHAR),
       CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE),
       CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE)
FROM base WHERE l_tax > 0""")
def q_eav_pivot_items(spark, sf_dir):
    return ops.eav_pivot_items(spark, sf_dir)


@register("customer_semi_join", with_model(["order_fact"], f"""
SELECT 'customer' AS customer_group, CAST(COUNT(*) AS BIGINT) AS orders, CAST(SUM(total) AS DOUBLE) AS sales
FROM order_fact WHERE {COMPLETED_ORDERS} AND customer_id > 0
UNION ALL
SELECT 'guest', CAST(COUNT(*) AS BIGINT), CAST(SUM(total) AS DOUBLE)
FROM order_fact WHERE {COMPLETED_ORDERS} AND customer_id = 0"""))
def q_customer_semi_join(spark, sf_dir):
    return ops.customer_semi_join(spark, sf_dir)


_STOCK_NUM = "COALESCE(TRY_CAST(NULLIF(regexp_extract(stock, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DECIMAL(18,4)), 0)"


@register("mysql_number_coercion", with_model(["order_fact", "item_fact", "product_dim"], f"""
SELECT meta_key, CAST(n AS BIGINT) AS n, CAST(total AS DOUBLE) AS total FROM (
  SELECT '_order_total' AS meta_key, COUNT(*) AS n, SUM(total) AS total FROM order_fact
  UNION ALL SELECT '_order_shipping', COUNT(*), SUM(shipping) FROM order_fact
  UNION ALL SELECT '_order_tax', COUNT(*), SUM(order_tax) FROM order_fact
  UNION ALL SELECT '_order_shipping_tax', COUNT(*), SUM(shipping_tax) FROM order_fact
  UNION ALL SELECT '_order_discount', COUNT(*), SUM(order_discount) FROM order_fact
  UNION ALL SELECT '_cart_discount', COUNT(*), SUM(cart_discount) FROM order_fact
  UNION ALL SELECT '_customer_user', COUNT(*), SUM(CAST(customer_id AS DECIMAL(18,4))) FROM order_fact
  UNION ALL SELECT '_manage_stock', COUNT(*), 0 FROM product_dim
  UNION ALL SELECT '_stock', COUNT(*), SUM({_STOCK_NUM}) FROM product_dim
  UNION ALL SELECT '_stock_status', COUNT(*), 0 FROM product_dim
  UNION ALL SELECT '_sku', COUNT(sku), 0 FROM product_dim
  UNION ALL SELECT '_qty', COUNT(*), SUM(qty) FROM item_fact WHERE item_type = 'line_item'
  UNION ALL SELECT '_line_total', COUNT(*), SUM(line_total) FROM item_fact WHERE item_type = 'line_item'
  UNION ALL SELECT '_product_id', COUNT(*), SUM(CAST(product_id * 4 + 1 AS DECIMAL(18,4)))
            FROM item_fact WHERE item_type = 'line_item'
  UNION ALL SELECT 'discount_amount', COUNT(*), SUM(discount_amount) FROM item_fact WHERE item_type = 'coupon'
  UNION ALL SELECT 'tax_amount', COUNT(*), SUM(tax_amount) FROM item_fact WHERE item_type = 'tax'
  UNION ALL SELECT 'shipping_tax_amount', COUNT(*), SUM(shipping_tax_amount) FROM item_fact WHERE item_type = 'tax'
) t"""))
def q_mysql_number_coercion(spark, sf_dir):
    return ops.mysql_number_coercion(spark, sf_dir)


@register("hook_override", with_model(["order_fact", "item_fact"], "SELECT * FROM t",
                                    extra=_TOTALS_BODY.lstrip("\n, ").replace(
                                        "SELECT SUM(total) AS s, COUNT(*) AS n,",
                                        "SELECT SUM(CASE WHEN shipping <> 25 THEN total END) AS s, "
                                        "COUNT(CASE WHEN shipping <> 25 THEN 1 END) AS n,")))
def q_hook_override(spark, sf_dir):
    return ops.hook_override(shop(spark, sf_dir))


@register("chart_series_monthly", with_model(["order_fact", "item_fact"], """
SELECT series, '[' || string_agg('[' || CAST(ms AS VARCHAR) || ',' || v || ']', ',' ORDER BY ms) || ']' AS points
FROM (SELECT 'order_counts' AS series, epoch_ms(CAST(month_start AS TIMESTAMP)) AS ms, CAST(orders AS VARCHAR) AS v
      FROM monthly
      UNION ALL
      SELECT 'order_amounts', epoch_ms(CAST(month_start AS TIMESTAMP)),
             CAST(CAST(sales_dec AS DECIMAL(20,2)) AS VARCHAR) FROM monthly) s
GROUP BY series""", extra=_MONTHLY))
def q_chart_series_monthly(spark, sf_dir):
    return ops.chart_series_monthly(shop(spark, sf_dir), P)


from .catalog import _ORACLE  # noqa: E402


@register("chart_series_signups", f"""
SELECT 'signups' AS series,
       '[' || string_agg('[' || CAST(epoch_ms(CAST(day AS TIMESTAMP)) AS VARCHAR) || ','
                         || CAST(signups AS VARCHAR) || ']', ',' ORDER BY day) || ']' AS points
FROM ({_ORACLE["customer_signups_daily"]}) q""")
def q_chart_series_signups(spark, sf_dir):
    return ops.chart_series_signups(shop(spark, sf_dir), P)


@register("chart_series_categories", f"""
SELECT category AS series,
       '[' || string_agg('[' || CAST(epoch_ms(make_timestamp({P.year}, month, 1, 0, 0, 0)) AS VARCHAR) || ','
                         || CAST(CAST(sales AS DECIMAL(20,2)) AS VARCHAR) || ']', ',' ORDER BY month) || ']' AS points
FROM ({_ORACLE["category_sales_monthly"]}) q
WHERE month IS NOT NULL
GROUP BY category""")
def q_chart_series_categories(spark, sf_dir):
    return ops.chart_series_categories(shop(spark, sf_dir), P)


@register("chart_series_coupons", f"""
SELECT coupon AS series,
       '[' || string_agg('[' || CAST(epoch_ms(make_timestamp({P.year}, month, 1, 0, 0, 0)) AS VARCHAR) || ','
                         || CAST(CAST(discount AS DECIMAL(20,4)) AS VARCHAR) || ']', ',' ORDER BY month) || ']' AS points
FROM ({_ORACLE["coupon_discounts_monthly"]}) q
WHERE coupon IS NOT NULL AND month IS NOT NULL
GROUP BY coupon""")
def q_chart_series_coupons(spark, sf_dir):
    return ops.chart_series_coupons(shop(spark, sf_dir), P)


# --------------------------------------------------------------------------
# streams (oracle: the batch report's SQL)

from .streaming import daily as streams  # noqa: E402


@register("daily_sales_stream", _ORACLE["daily_sales"])
def q_daily_sales_stream(spark, sf_dir):
    paths = streams.run_daily_sales_stream(spark, sf_dir, P, glob="orders.parquet")
    return streams.read_daily_sales(spark, paths, P)


@register("signups_stream", _ORACLE["customer_signups_daily"])
def q_signups_stream(spark, sf_dir):
    paths = streams.run_signups_stream(spark, sf_dir, P, glob="events.parquet")
    return streams.read_signups(spark, paths, P)
