"""Registered queries: every operator with the fixture's parameter windows.

The original analysis used 2012 dates; the fixture (derived from the
``events`` table, January 2024) needs its own windows, listed here once.
Each entry takes ``(spark, data_dir)`` and returns a lazy DataFrame over the
whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionscope import operators as ops
from sessionscope.rollups import build_session_facts, build_session_sets, read_session_facts, read_session_sets
from sessionscope.session import ensure_checkpoint_dir
from sessionscope.sources.tables import ShopTables

# Fixed parameter windows for the January 2024 fixture.
END_0120 = "2024-01-20"
END_0122 = "2024-01-22"
END_0128 = "2024-01-28"
END_0131 = "2024-01-31"
MONTH_START = "2024-01-01"
CH_START, CH_END = "2024-01-05", "2024-01-25"
T5_START, T5_END = "2024-01-03", "2024-01-29"
B2_START, B2_END = "2024-01-05", "2024-01-25"
W16_START, W16_END = "2024-01-02", "2024-01-29"
FUNNEL_START, FUNNEL_END = "2024-01-05", "2024-01-25"
PAID = {"utm_source": "gsearch", "utm_campaign": "nonbrand"}

Query = Callable[[SparkSession, str], DataFrame]

# Which tables an operator takes, in order: s = sessions, p = pageviews, o = orders.
_TABLES = {"s": "sessions", "p": "pageviews", "o": "orders"}


class Spec:
    """An operator with its fixture parameters; runs on any ``ShopTables``."""

    def __init__(self, fn, tables: str, **params) -> None:
        self.fn, self.tables, self.params = fn, tables, params

    def on(self, shop: ShopTables) -> DataFrame:
        return self.fn(*[getattr(shop, _TABLES[t]) for t in self.tables], **self.params)

    def __call__(self, spark: SparkSession, data_dir: str) -> DataFrame:
        return self.on(ShopTables.from_events(spark, data_dir))


def _s(fn, **kw) -> Spec:
    return Spec(fn, "s", **kw)


def _so(fn, **kw) -> Spec:
    return Spec(fn, "so", **kw)


def _sp(fn, **kw) -> Spec:
    return Spec(fn, "sp", **kw)


def _p(fn, **kw) -> Spec:
    return Spec(fn, "p", **kw)


def _po(fn, **kw) -> Spec:
    return Spec(fn, "po", **kw)


_LANDING_TEST = dict(PAID, end=END_0128)
_LANDING_TREND = dict(PAID, start=W16_START, end=W16_END)
_FUNNEL = dict(PAID, start=FUNNEL_START, end=FUNNEL_END)
_VARIANT = dict(end=END_0128)

QUERIES: dict[str, Spec] = {
    # traffic
    "top_traffic_sources": _s(ops.top_traffic_sources, end=END_0120),
    "conversion_rate": _so(ops.conversion_rate, **PAID, end=END_0120),
    "weekly_session_trend": _s(ops.weekly_session_trend, **PAID, end=END_0131),
    "weekly_session_trend_keys": _s(ops.weekly_session_trend, **PAID, end=END_0131, include_week_keys=True),
    "conversion_by_device": _so(ops.conversion_by_device, **PAID, end=END_0120),
    "weekly_sessions_by_device": _s(ops.weekly_sessions_by_device, **PAID, start=T5_START, end=T5_END),
    # seasonality
    "weekly_sessions_orders": _so(ops.weekly_sessions_orders, end=END_0131),
    "hourly_weekday_profile": _s(ops.hourly_weekday_profile, start=B2_START, end=B2_END),
    # channel portfolio
    "weekly_sources": _s(ops.weekly_sources, start=MONTH_START, end=END_0131),
    "source_mobile_share": _s(ops.source_mobile_share, start=CH_START, end=CH_END),
    "conversion_by_device_source": _so(ops.conversion_by_device_source, start=CH_START, end=CH_END),
    "weekly_source_device_ratio": _s(ops.weekly_source_device_ratio, start=MONTH_START, end=END_0131),
    "classify_channel": _s(ops.classify_channel),
    "monthly_channel_mix": _s(ops.monthly_channel_mix, end=END_0131),
    # pages, entry pages, bounce
    "top_pages": _p(ops.top_pages, end=END_0122),
    "first_pageview_per_session": _p(ops.first_pageview_per_session, end=END_0120),
    "min_pageview_per_session": _p(ops.first_pageview_per_session, end=END_0122, id_alias="min_pageview_id"),
    "top_entry_pages": _p(ops.top_entry_pages, end=END_0120),
    "sessions_with_landing_page": _p(ops.sessions_with_landing_page, end=END_0122, landing_page="/home"),
    "bounced_sessions": _p(ops.bounced_sessions, end=END_0122, landing_page="/home"),
    "bounce_markers": _p(ops.bounce_markers, end=END_0122, landing_page="/home"),
    "bounce_rate": _p(ops.bounce_rate, end=END_0122, landing_page="/home"),
    # landing-page test and trend
    "page_launch": _p(ops.page_launch, page="/lander-1"),
    "test_first_pageviews": _sp(ops.test_first_pageviews, **_LANDING_TEST),
    "test_landing_pages": _sp(ops.test_landing_pages, **_LANDING_TEST),
    "test_bounced_sessions": _sp(ops.test_bounced_sessions, **_LANDING_TEST),
    "test_bounce_markers": _sp(ops.test_bounce_markers, **_LANDING_TEST),
    "bounce_rate_by_landing_page": _sp(ops.bounce_rate_by_landing_page, **_LANDING_TEST),
    "session_first_pv_and_count": _sp(ops.session_first_pv_and_count, **_LANDING_TREND),
    "session_landing_details": _sp(ops.session_landing_details, **_LANDING_TREND),
    "weekly_bounce_trend": _sp(ops.weekly_bounce_trend, **_LANDING_TREND),
    "weekly_bounce_trend_counts": _sp(ops.weekly_bounce_trend, **_LANDING_TREND, include_counts=True),
    # funnel
    "funnel_pageview_flags": _sp(ops.funnel_pageview_flags, **_FUNNEL),
    "session_funnel_flags": _sp(ops.session_funnel_flags, **_FUNNEL),
    "funnel_counts": _sp(ops.funnel_counts, **_FUNNEL),
    "funnel_rates": _sp(ops.funnel_rates, **_FUNNEL),
    # variant test
    "variant_launch": _p(ops.variant_launch, page="/billing-2"),
    "variant_sessions_orders": _po(ops.variant_sessions_orders, **_VARIANT),
    "variant_conversion": _po(ops.variant_conversion, **_VARIANT),
}



class OverSets:
    """An operator's spec over stored sets of sessions, built from the tables first."""

    def __init__(self, name: str, unit: str = "day") -> None:
        self.spec, self.unit = QUERIES[name], unit

    def on(self, shop: ShopTables) -> DataFrame:
        spark = shop.sessions.sparkSession
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/session-sets-{uuid.uuid4().hex}"
        build_session_sets(shop, root, self.unit)
        sets = read_session_sets(spark, root, self.unit)
        return self.spec.on(ShopTables(sessions=sets, orders=sets))

    def __call__(self, spark: SparkSession, data_dir: str) -> DataFrame:
        return self.on(ShopTables.from_events(spark, data_dir))


# Operators that count sessions (and their orders), answered from stored sets.
SET_QUERIES: dict[str, OverSets] = {
    "sets_top_traffic_sources": OverSets("top_traffic_sources"),
    "sets_weekly_sessions_by_device": OverSets("weekly_sessions_by_device"),
    "sets_conversion_by_device_source": OverSets("conversion_by_device_source"),
    "sets_monthly_channel_mix": OverSets("monthly_channel_mix"),
    "sets_hourly_weekday_profile": OverSets("hourly_weekday_profile", unit="hour"),
}

FACT_PAGES = tuple(s.url for s in ops.DEFAULT_STEPS) + ("/home", "/lander-1")


class OverFacts:
    """An operator's spec over stored session facts, built from the tables first."""

    def __init__(self, name: str) -> None:
        self.spec = QUERIES[name]

    def on(self, shop: ShopTables) -> DataFrame:
        spark = shop.sessions.sparkSession
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/session-facts-{uuid.uuid4().hex}"
        build_session_facts(shop, root, pages=FACT_PAGES, launches=("/lander-1",))
        facts = read_session_facts(spark, root)
        return self.spec.on(ShopTables(sessions=facts, pageviews=facts))

    def __call__(self, spark: SparkSession, data_dir: str) -> DataFrame:
        return self.on(ShopTables.from_events(spark, data_dir))


# Operators on landings, bounces and funnel steps, answered from stored facts.
FACT_QUERIES: dict[str, OverFacts] = {
    f"facts_{name}": OverFacts(name)
    for name in ("bounce_rate", "bounce_rate_by_landing_page", "weekly_bounce_trend_counts", "funnel_rates")
}

FLAGSHIP = "bounce_rate_by_landing_page"
