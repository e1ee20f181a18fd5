"""The feeds as plain SQL CTEs (DuckDB), for the oracle queries.

This is an independent formulation of ``shoplens.sources.feeds``: one window
per user for sessionization (fine for an oracle at small scale), joins and
ROW_NUMBER for the commerce tables.  Logical table names are
``website_sessions``, ``website_pageviews``, ``web_orders`` (web feed) and
``store_orders``, ``order_items``, ``order_item_refunds`` (commerce feed);
the driver's own ``orders`` view is the TPC-H-like source table.
"""

WEB_FEED = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
  FROM events
),
ev_start AS (
  SELECT *,
         CASE WHEN prev_ts IS NULL OR ts > prev_ts + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS is_start
  FROM ev
),
ev_sn AS (
  SELECT *, SUM(is_start) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sn
  FROM ev_start
),
ev_sess AS (
  SELECT *,
         FIRST_VALUE(event_id) OVER (PARTITION BY user_id, sn ORDER BY ts, event_id) AS sid,
         ROW_NUMBER() OVER (PARTITION BY user_id, sn ORDER BY ts, event_id) AS pos
  FROM ev_sn
),
website_sessions AS (
  SELECT sid AS website_session_id,
         ts AS created_at,
         user_id,
         CASE WHEN sn > 1 THEN 1 ELSE 0 END AS is_repeat_session,
         CASE WHEN k BETWEEN 0 AND 39 THEN 'gsearch'
              WHEN k BETWEEN 40 AND 59 THEN 'bsearch'
              WHEN k BETWEEN 60 AND 69 THEN 'socialbook' END AS utm_source,
         CASE WHEN k BETWEEN 0 AND 29 THEN 'nonbrand'
              WHEN k BETWEEN 30 AND 39 THEN 'brand'
              WHEN k BETWEEN 40 AND 54 THEN 'nonbrand'
              WHEN k BETWEEN 55 AND 59 THEN 'brand'
              WHEN k BETWEEN 60 AND 69 THEN 'pilot' END AS utm_campaign,
         CASE WHEN k BETWEEN 0 AND 39 OR k BETWEEN 70 AND 79 THEN 'https://www.gsearch.com'
              WHEN k BETWEEN 40 AND 59 OR k BETWEEN 80 AND 89 THEN 'https://www.bsearch.com'
              WHEN k BETWEEN 60 AND 69 THEN 'https://www.socialbook.com' END AS http_referer,
         CASE WHEN sid % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type
  FROM ev_sess
  WHERE pos = 1
),
website_pageviews AS (
  SELECT event_id AS website_pageview_id,
         ts AS created_at,
         sid AS website_session_id,
         CASE WHEN pos = 1 THEN CASE k % 3 WHEN 0 THEN '/home' WHEN 1 THEN '/lander-1' ELSE '/lander-2' END
              WHEN event_type = 'click' THEN '/products'
              WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN '/the-original-mr-fuzzy'
                                                 ELSE '/the-forever-love-bear' END
              WHEN event_type = 'signup' THEN '/cart'
              WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN '/shipping' WHEN 1 THEN '/billing'
                                                  ELSE '/billing-2' END
              WHEN event_type = 'purchase' THEN '/thank-you-for-your-order' END AS pageview_url
  FROM ev_sess
),
web_orders AS (
  SELECT event_id AS order_id,
         ts AS created_at,
         sid AS website_session_id,
         CAST(1 + k % 4 AS INTEGER) AS primary_product_id,
         CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS items_purchased,
         CAST(value AS DECIMAL(12,2)) AS price_usd,
         CAST(CAST(value AS DECIMAL(12,2)) * 0.40 AS DECIMAL(16,4)) AS cogs_usd
  FROM ev_sess
  WHERE event_type = 'purchase'
)"""

COMMERCE_FEED = """
li AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey
                               ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
  FROM lineitem
),
order_items AS (
  SELECT l_orderkey * 1000000 + rn AS order_item_id,
         l_orderkey AS order_id,
         CAST(1 + l_partkey % 4 AS INTEGER) AS product_id,
         CAST(CASE WHEN rn = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_primary_item,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price_usd,
         l_shipdate AS created_at
  FROM li
),
store_orders AS (
  SELECT o.o_orderkey AS order_id,
         o.o_orderdate AS created_at,
         CAST(NULL AS BIGINT) AS website_session_id,
         prim.product_id AS primary_product_id,
         CAST(COALESCE(cnt.n, 0) AS INTEGER) AS items_purchased,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS price_usd,
         CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) * 0.60 AS DECIMAL(16,4)) AS cogs_usd
  FROM orders o
  LEFT JOIN (SELECT order_id, COUNT(*) AS n FROM order_items GROUP BY order_id) cnt
         ON cnt.order_id = o.o_orderkey
  LEFT JOIN (SELECT order_id, product_id FROM order_items WHERE is_primary_item = 1) prim
         ON prim.order_id = o.o_orderkey
),
order_item_refunds AS (
  SELECT (li.l_orderkey * 1000000 + li.rn) * 10 + j.j AS order_item_refund_id,
         li.l_orderkey * 1000000 + li.rn AS order_item_id,
         CAST(li.l_extendedprice AS DECIMAL(12,2)) AS refund_amount_usd,
         li.l_shipdate + to_days(CAST(li.l_linenumber AS INTEGER)) AS created_at
  FROM li
  JOIN (VALUES (0), (1)) AS j(j) ON j.j = 0 OR li.l_linenumber = 7
  WHERE li.l_returnflag = 'R'
)"""


def with_feeds(body: str, web: bool = False, commerce: bool = False) -> str:
    """Prefix ``body`` (``name AS (...), ... SELECT ...`` or a bare SELECT)
    with the feed CTEs it needs."""
    ctes = [c.strip() for c, on in ((WEB_FEED, web), (COMMERCE_FEED, commerce)) if on]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
    return "WITH " + ",\n".join(ctes + [body])
