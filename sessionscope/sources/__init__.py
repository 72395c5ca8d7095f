"""Sources: the shop tables (sessions, pageviews, orders) and their derivation."""

from sessionscope.sources.events import (
    orders_from_events,
    pageviews_from_events,
    sessions_from_events,
)
from sessionscope.sources.schemas import (
    ORDER_ID,
    ORDERS_SCHEMA,
    PAGEVIEW_ID,
    PAGEVIEWS_SCHEMA,
    SESSION_ID,
    SESSIONS_SCHEMA,
)
from sessionscope.sources.tables import ShopTables

__all__ = [
    "ORDER_ID",
    "ORDERS_SCHEMA",
    "PAGEVIEW_ID",
    "PAGEVIEWS_SCHEMA",
    "SESSION_ID",
    "SESSIONS_SCHEMA",
    "ShopTables",
    "orders_from_events",
    "pageviews_from_events",
    "sessions_from_events",
]
