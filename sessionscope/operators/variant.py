"""Variant (A/B) page test: sessions that saw each variant and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.metrics import order_total, orders_per_session, ratio
from sessionscope.functions.timebuckets import TimeBound, within
from sessionscope.operators.common import sql_string
from sessionscope.plans.joins import hot_key_left_join
from sessionscope.sources.schemas import ORDER_ID, PAGEVIEW_ID, SESSION_ID

OLD_BILLING, NEW_BILLING = "/billing", "/billing-2"


def variant_launch(pageviews: DataFrame, *, page: str = NEW_BILLING) -> DataFrame:
    """First pageview id of the new variant.  Out: first_pv_id."""
    return pageviews.filter(f"pageview_url = {sql_string(page)}").agg(
        F.min(PAGEVIEW_ID).alias("first_pv_id")
    )


def _variant_views(
    pageviews: DataFrame, launch_page: str, end: TimeBound, variants: tuple[str, ...]
) -> DataFrame:
    """Variant pageviews from the launch id on (inclusive) and before ``end``."""
    launch_id = variant_launch(pageviews, page=launch_page).scalar()
    in_variants = f"pageview_url IN ({', '.join(sql_string(v) for v in variants)})"
    return (
        within(pageviews, end=end, extra_sql=in_variants)
        .filter(F.col(PAGEVIEW_ID) >= launch_id)
        .selectExpr(SESSION_ID, PAGEVIEW_ID, "pageview_url AS billing_version_seen")
    )


def variant_sessions_orders(
    pageviews: DataFrame,
    orders: DataFrame,
    *,
    launch_page: str = NEW_BILLING,
    end: TimeBound = "2012-11-10",
    variants: tuple[str, ...] = (OLD_BILLING, NEW_BILLING),
) -> DataFrame:
    """Each variant pageview with each order of its session (NULL when none).

    One row per (pageview, order) pair of a session, as the detail listing
    defines it; ``variant_conversion`` does not go through these pairs.
    Out: website_session_id, billing_version_seen, order_id.
    """
    views = _variant_views(pageviews, launch_page, end, variants)
    session_orders = orders.select(SESSION_ID, ORDER_ID)
    return hot_key_left_join(
        views, session_orders, SESSION_ID, left_id=PAGEVIEW_ID, right_id=ORDER_ID
    ).select(SESSION_ID, "billing_version_seen", ORDER_ID)


def variant_conversion(
    pageviews: DataFrame,
    orders: DataFrame,
    *,
    launch_page: str = NEW_BILLING,
    end: TimeBound = "2012-11-10",
    variants: tuple[str, ...] = (OLD_BILLING, NEW_BILLING),
) -> DataFrame:
    """Per variant: sessions that saw it, their orders, orders / sessions.

    A session that saw both variants counts in both.  Distinct (variant,
    session) pairs are formed map-side, then joined one-to-one with the
    per-session order counts.
    Out: billing_version_seen, sessions, orders, billing_to_order_rt.
    """
    seen = _variant_views(pageviews, launch_page, end, variants).drop(PAGEVIEW_ID).distinct()
    return (
        seen.join(orders_per_session(orders, seen), SESSION_ID, "left")
        .groupBy("billing_version_seen")
        .agg(F.count(SESSION_ID).alias("sessions"), order_total().alias("orders"))
        .select(
            "billing_version_seen",
            "sessions",
            "orders",
            ratio("orders", "sessions").alias("billing_to_order_rt"),
        )
    )
