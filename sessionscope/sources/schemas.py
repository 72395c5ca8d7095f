"""Declared schemas of the three shop tables.

Keys: ``website_session_id`` identifies a session, ``website_pageview_id`` a
pageview and ``order_id`` an order; an order belongs to one session and pageview
ids rise with time.  Repeated rows of a key count once where the analysis counts
distinct keys; ``validate_keys`` reports whether keys are unique.
"""

from __future__ import annotations

from pyspark.sql import types as T

SESSION_ID = "website_session_id"
PAGEVIEW_ID = "website_pageview_id"
ORDER_ID = "order_id"

SESSIONS_SCHEMA = T.StructType(
    [
        T.StructField(SESSION_ID, T.LongType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("utm_source", T.StringType(), True),
        T.StructField("utm_campaign", T.StringType(), True),
        T.StructField("device_type", T.StringType(), True),
        T.StructField("http_referer", T.StringType(), True),
    ]
)

PAGEVIEWS_SCHEMA = T.StructType(
    [
        T.StructField(PAGEVIEW_ID, T.LongType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField(SESSION_ID, T.LongType(), False),
        T.StructField("pageview_url", T.StringType(), True),
    ]
)

ORDERS_SCHEMA = T.StructType(
    [
        T.StructField(ORDER_ID, T.LongType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField(SESSION_ID, T.LongType(), False),
        T.StructField("price_usd", T.DoubleType(), True),
    ]
)

# The driver's event stream table, from which the fixture tables are derived.
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("event_type", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("props", T.StringType(), True),
    ]
)

SCHEMAS = {
    "website_sessions": SESSIONS_SCHEMA,
    "website_pageviews": PAGEVIEWS_SCHEMA,
    "shop_orders": ORDERS_SCHEMA,
}

# What identifies a row of each table.
ROW_IDS = {"website_sessions": SESSION_ID, "website_pageviews": PAGEVIEW_ID, "shop_orders": ORDER_ID}

# Columns an operator may not run without (price_usd is carried, never read).
REQUIRED_COLUMNS = {
    "website_sessions": [f.name for f in SESSIONS_SCHEMA.fields],
    "website_pageviews": [f.name for f in PAGEVIEWS_SCHEMA.fields],
    "shop_orders": [ORDER_ID, "created_at", SESSION_ID],
}
