"""Traffic-source analysis: sources, conversion, weekly and device trends.

Defaults are the values of the original analysis (spring 2012, gsearch
nonbrand); every literal is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.metrics import conversion_counts, distinct_counts, ratio
from sessionscope.functions.timebuckets import TimeBound, week_sunday0, within
from sessionscope.operators.common import session_cohort, sql_string


def top_traffic_sources(sessions: DataFrame, *, end: TimeBound = "2012-04-12") -> DataFrame:
    """Sessions per (utm_source, utm_campaign, http_referer), largest first.

    NULL attribute values form their own groups.
    Out: utm_source, utm_campaign, http_referer, number_of_sessions.
    """
    groups = [F.col(c) for c in ("utm_source", "utm_campaign", "http_referer")]
    return distinct_counts(within(sessions, end=end), groups, total="number_of_sessions").orderBy(
        F.desc("number_of_sessions")
    )


def conversion_rate(
    sessions: DataFrame,
    orders: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    end: TimeBound = "2012-04-12",
) -> DataFrame:
    """One row: sessions, their orders and 100 * orders / sessions (2 decimals).

    Out: total_sessions, total_orders, conversion_rate (NULL without sessions).
    """
    cohort = session_cohort(sessions, utm_source=utm_source, utm_campaign=utm_campaign, end=end)
    totals = conversion_counts(cohort, orders, [], sessions="total_sessions", total="total_orders")
    return totals.select(
        "total_sessions",
        "total_orders",
        F.expr(
            "round(try_divide(CAST(total_orders * 100 AS DOUBLE), CAST(total_sessions AS DOUBLE)), 2)"
        ).alias("conversion_rate"),
    )


def weekly_session_trend(
    sessions: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    end: TimeBound = "2012-05-10",
    include_week_keys: bool = False,
) -> DataFrame:
    """Sessions per YEAR/WEEK (Sunday weeks), labelled by the first date seen.

    Out: week_started_at, sessions (+ yr, wk first when ``include_week_keys``).
    """
    cohort = session_cohort(sessions, utm_source=utm_source, utm_campaign=utm_campaign, end=end)
    weekly = distinct_counts(
        cohort,
        [F.year("created_at").alias("yr"), week_sunday0("created_at").alias("wk")],
        total="sessions",
        first={"week_started_at": F.to_date("created_at")},
    )
    cols = (["yr", "wk"] if include_week_keys else []) + ["week_started_at", "sessions"]
    return weekly.orderBy("week_started_at").select(*cols)


def conversion_by_device(
    sessions: DataFrame,
    orders: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    end: TimeBound = "2012-05-11",
) -> DataFrame:
    """Sessions, orders and orders/sessions per device type.

    Out: device_type, sessions, orders, session_to_order_cvr.
    """
    cohort = session_cohort(sessions, utm_source=utm_source, utm_campaign=utm_campaign, end=end)
    return conversion_counts(cohort, orders, [F.col("device_type")]).select(
        "device_type",
        "sessions",
        "orders",
        ratio("orders", "sessions").alias("session_to_order_cvr"),
    )


def weekly_sessions_by_device(
    sessions: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-04-15",
    end: TimeBound = "2012-06-09",
    devices: tuple[str, ...] = ("desktop", "mobile"),
) -> DataFrame:
    """Weekly sessions pivoted by device, for ``start < created_at < end``.

    Out: yr, wk, week_start_date, <device>_sessions…, total_sessions.
    """
    cohort = session_cohort(
        sessions,
        utm_source=utm_source,
        utm_campaign=utm_campaign,
        start=start,
        end=end,
        start_exclusive=True,
    )
    per_device = {f"{d}_sessions": f"device_type = {sql_string(d)}" for d in devices}
    weekly = distinct_counts(
        cohort,
        [F.year("created_at").alias("yr"), week_sunday0("created_at").alias("wk")],
        total="total_sessions",
        when=per_device,
        first={"week_start_date": F.to_date("created_at")},
    )
    return weekly.select("yr", "wk", "week_start_date", *per_device, "total_sessions").orderBy("yr", "wk")
