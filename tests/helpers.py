"""Shared test helpers: build shop tables from rows, compare frames."""

from __future__ import annotations

import datetime as dt
import math

from sessionscope.sources.schemas import ORDERS_SCHEMA, PAGEVIEWS_SCHEMA, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def shop(spark, sessions=(), pageviews=(), orders=()) -> ShopTables:
    """sessions: (id, created_at, source, campaign, device, referer);
    pageviews: (id, created_at, session_id, url); orders: (id, created_at, session_id)."""
    s = spark.createDataFrame([(a, ts(b), c, d, e, f) for a, b, c, d, e, f in sessions], SESSIONS_SCHEMA)
    p = spark.createDataFrame([(a, ts(b), c, d) for a, b, c, d in pageviews], PAGEVIEWS_SCHEMA)
    o = spark.createDataFrame([(a, ts(b), c, None) for a, b, c in orders], ORDERS_SCHEMA)
    return ShopTables(s, p, o)


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(df, order_insensitive=True):
    out = [tuple(norm(x) for x in r) for r in df.collect()]
    return sorted(out, key=repr) if order_insensitive else out
