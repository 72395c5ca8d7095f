"""Structured Streaming upkeep of the shop tables from an event stream."""

from sessionscope.streaming.ingest import (
    ShopIngest,
    event_stream,
    append_events,
    sessions_from_pageviews,
    start_shop_ingest,
)

__all__ = ["ShopIngest", "event_stream", "append_events", "sessions_from_pageviews", "start_shop_ingest"]
