"""Schemas of the five logical tables the analyses read.

Ids are primary keys (``website_session_id`` in sessions, ``order_id`` in
orders, ...).  Operators rely on that: ``COUNT(DISTINCT pk)`` over a table
with no fan-out join is computed as a plain count.
"""

from pyspark.sql import types as T

ID = T.LongType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)
COST = T.DecimalType(16, 4)

WEBSITE_SESSIONS = T.StructType([
    T.StructField("website_session_id", ID, False),
    T.StructField("created_at", TS, True),
    T.StructField("user_id", ID, True),
    T.StructField("is_repeat_session", T.IntegerType(), True),
    T.StructField("utm_source", T.StringType(), True),
    T.StructField("utm_campaign", T.StringType(), True),
    T.StructField("http_referer", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
])

WEBSITE_PAGEVIEWS = T.StructType([
    T.StructField("website_pageview_id", ID, False),
    T.StructField("created_at", TS, True),
    T.StructField("website_session_id", ID, True),
    T.StructField("pageview_url", T.StringType(), True),
])

ORDERS = T.StructType([
    T.StructField("order_id", ID, False),
    T.StructField("created_at", TS, True),
    T.StructField("website_session_id", ID, True),
    T.StructField("primary_product_id", T.IntegerType(), True),
    T.StructField("items_purchased", T.IntegerType(), True),
    T.StructField("price_usd", MONEY, True),
    T.StructField("cogs_usd", COST, True),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", ID, False),
    T.StructField("order_id", ID, True),
    T.StructField("product_id", T.IntegerType(), True),
    T.StructField("is_primary_item", T.IntegerType(), True),
    T.StructField("price_usd", MONEY, True),
    T.StructField("created_at", TS, True),
])

ORDER_ITEM_REFUNDS = T.StructType([
    T.StructField("order_item_refund_id", ID, False),
    T.StructField("order_item_id", ID, True),
    T.StructField("refund_amount_usd", MONEY, True),
    T.StructField("created_at", TS, True),
])

TABLES = {
    "website_sessions": WEBSITE_SESSIONS,
    "website_pageviews": WEBSITE_PAGEVIEWS,
    "web_orders": ORDERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_item_refunds": ORDER_ITEM_REFUNDS,
}
