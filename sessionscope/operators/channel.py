"""Channel portfolio: paid sources side by side, device mix, channel groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.metrics import conversion_counts, distinct_counts, ratio
from sessionscope.functions.timebuckets import TimeBound, within, yearweek_sunday
from sessionscope.operators.common import session_cohort, sql_string
from sessionscope.sources.schemas import SESSION_ID

# Fixed values of the channel rules (search-engine referers, campaign names,
# group labels).
ORGANIC_REFERERS = ("https://www.gsearch.com", "https://www.bsearch.com")
NONBRAND, BRAND = "nonbrand", "brand"
ORGANIC_SEARCH, PAID_NONBRAND, PAID_BRAND, DIRECT_TYPE_IN = (
    "organic_search",
    "paid_nonbrand",
    "paid_brand",
    "direct_type_in",
)


def weekly_sources(
    sessions: DataFrame,
    *,
    utm_campaign: str = NONBRAND,
    sources: tuple[str, ...] = ("gsearch", "bsearch"),
    start: TimeBound = "2012-08-22",
    end: TimeBound = "2012-11-29",
) -> DataFrame:
    """Weekly (YEARWEEK) sessions of one campaign: total and per source.

    Out: yrwk, week_start_date, total_<campaign>_sessions, <source>_sessions…
    """
    cohort = session_cohort(sessions, utm_campaign=utm_campaign, start=start, end=end)
    return distinct_counts(
        cohort,
        [yearweek_sunday("created_at").alias("yrwk")],
        total=f"total_{utm_campaign}_sessions",
        when={f"{s}_sessions": f"utm_source = {sql_string(s)}" for s in sources},
        first={"week_start_date": F.to_date("created_at")},
    ).orderBy("yrwk")


def source_mobile_share(
    sessions: DataFrame,
    *,
    utm_campaign: str = NONBRAND,
    sources: tuple[str, ...] = ("gsearch", "bsearch"),
    device: str = "mobile",
    start: TimeBound = "2012-08-22",
    end: TimeBound = "2012-11-30",
) -> DataFrame:
    """Per source: sessions, mobile sessions and their share.

    Out: utm_source, sessions, mobile_sessions, pct_mobile.
    """
    cohort = session_cohort(sessions, utm_campaign=utm_campaign, start=start, end=end).filter(
        f"utm_source IN ({', '.join(sql_string(s) for s in sources)})"
    )
    counts = distinct_counts(
        cohort,
        [F.col("utm_source")],
        total="sessions",
        when={"mobile_sessions": f"device_type = {sql_string(device)}"},
    )
    return counts.select(
        "utm_source", "sessions", "mobile_sessions", ratio("mobile_sessions", "sessions").alias("pct_mobile")
    )


def conversion_by_device_source(
    sessions: DataFrame,
    orders: DataFrame,
    *,
    utm_campaign: str = NONBRAND,
    start: TimeBound = "2012-08-22",
    end: TimeBound = "2012-09-19",
) -> DataFrame:
    """Sessions, orders and conversion per (device_type, utm_source).

    Out: device_type, utm_source, sessions, orders, conv_rate.
    """
    cohort = session_cohort(sessions, utm_campaign=utm_campaign, start=start, end=end)
    return conversion_counts(cohort, orders, [F.col("device_type"), F.col("utm_source")]).select(
        "device_type", "utm_source", "sessions", "orders", ratio("orders", "sessions").alias("conv_rate")
    )


def weekly_source_device_ratio(
    sessions: DataFrame,
    *,
    utm_campaign: str = NONBRAND,
    base_source: str = "gsearch",
    other_source: str = "bsearch",
    start: TimeBound = "2012-11-04",
    end: TimeBound = "2012-12-22",
) -> DataFrame:
    """Weekly sessions of two sources per device and other ÷ base per device.

    Out: year_week, week_start_date, g_dtop_sessions, b_dtop_sessions,
    b_pct_of_g_dtop, g_mob_sessions, b_mob_sessions, b_pct_of_g_mob
    (g = base source, b = other source; ratio NULL when the base has none).
    """
    cohort = session_cohort(sessions, utm_campaign=utm_campaign, start=start, end=end)

    def is_of(source: str, device: str) -> str:
        return f"utm_source = {sql_string(source)} AND device_type = {sql_string(device)}"

    weekly = distinct_counts(
        cohort,
        [yearweek_sunday("created_at").alias("year_week")],
        when={
            "g_dtop_sessions": is_of(base_source, "desktop"),
            "b_dtop_sessions": is_of(other_source, "desktop"),
            "g_mob_sessions": is_of(base_source, "mobile"),
            "b_mob_sessions": is_of(other_source, "mobile"),
        },
        first={"week_start_date": F.to_date("created_at")},
    )
    return weekly.orderBy("week_start_date").select(
        "year_week",
        "week_start_date",
        "g_dtop_sessions",
        "b_dtop_sessions",
        ratio("b_dtop_sessions", "g_dtop_sessions").alias("b_pct_of_g_dtop"),
        "g_mob_sessions",
        "b_mob_sessions",
        ratio("b_mob_sessions", "g_mob_sessions").alias("b_pct_of_g_mob"),
    )


def channel_group(organic_referers: tuple[str, ...] = ORGANIC_REFERERS) -> Column:
    """Channel class of a session; first matching rule wins, no match is NULL."""
    referers = ", ".join(sql_string(r) for r in organic_referers)
    return F.expr(
        "CASE"
        f" WHEN utm_source IS NULL AND http_referer IN ({referers}) THEN {sql_string(ORGANIC_SEARCH)}"
        f" WHEN utm_campaign = {sql_string(NONBRAND)} THEN {sql_string(PAID_NONBRAND)}"
        f" WHEN utm_campaign = {sql_string(BRAND)} THEN {sql_string(PAID_BRAND)}"
        f" WHEN utm_source IS NULL AND http_referer IS NULL THEN {sql_string(DIRECT_TYPE_IN)}"
        " END"
    )


def classify_channel(
    sessions: DataFrame,
    *,
    organic_referers: tuple[str, ...] = ORGANIC_REFERERS,
    end: TimeBound = None,
) -> DataFrame:
    """Row-level channel group of every session (narrow projection, no shuffle).

    Out: website_session_id, created_at, channel_group.
    """
    return within(sessions, end=end).select(
        SESSION_ID, "created_at", channel_group(organic_referers).alias("channel_group")
    )


def monthly_channel_mix(
    sessions: DataFrame,
    *,
    end: TimeBound = "2012-12-23",
    organic_referers: tuple[str, ...] = ORGANIC_REFERERS,
) -> DataFrame:
    """Monthly sessions per channel group and each group's ratio to paid nonbrand.

    Out: yr, mo, nonbrand, brand, brand_pct_of_nonbrand, direct,
    direct_pct_of_nonbrand, organic, organic_pct_of_nonbrand.
    """
    classified = within(sessions, end=end).withColumn("channel_group", channel_group(organic_referers))
    groups = {"nonbrand": PAID_NONBRAND, "brand": PAID_BRAND, "direct": DIRECT_TYPE_IN, "organic": ORGANIC_SEARCH}
    monthly = distinct_counts(
        classified,
        [F.year("created_at").alias("yr"), F.month("created_at").alias("mo")],
        when={name: f"channel_group = {sql_string(label)}" for name, label in groups.items()},
    )
    return monthly.orderBy("yr", "mo").select(
        "yr",
        "mo",
        "nonbrand",
        "brand",
        ratio("brand", "nonbrand").alias("brand_pct_of_nonbrand"),
        "direct",
        ratio("direct", "nonbrand").alias("direct_pct_of_nonbrand"),
        "organic",
        ratio("organic", "nonbrand").alias("organic_pct_of_nonbrand"),
    )
