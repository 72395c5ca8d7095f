"""Cohort filters shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.timebuckets import TimeBound, of_session_days, within
from sessionscope.sources.schemas import SESSION_ID


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def campaign_filter_sql(utm_source: str | None = None, utm_campaign: str | None = None) -> str:
    parts = []
    if utm_source is not None:
        parts.append(f"utm_source = {sql_string(utm_source)}")
    if utm_campaign is not None:
        parts.append(f"utm_campaign = {sql_string(utm_campaign)}")
    return " AND ".join(parts) or "TRUE"


def campaign_filter(utm_source: str | None = None, utm_campaign: str | None = None) -> Column:
    """``utm_source = s AND utm_campaign = c`` (a None argument is not tested)."""
    return F.expr(campaign_filter_sql(utm_source, utm_campaign))


def cohort_pageviews(
    pageviews: DataFrame, cohort: DataFrame, start: TimeBound = None, end: TimeBound = None
) -> DataFrame:
    """The pageviews among which are all those of the cohort's sessions, whenever they happened.

    ``start`` and ``end`` are the cohort's window.  Where the pageviews know the day of
    their session, those of the window's days, at the scan; otherwise exactly the cohort's,
    by a semi join: with a cohort of a size that Spark broadcasts it filters the scan's
    rows in place; for a larger one Spark adds a bloom filter of the cohort below the
    shuffle (``session._BASE_CONF``).
    """
    near = of_session_days(pageviews, cohort, start, end)
    return near if near is not None else pageviews.join(cohort.select(SESSION_ID), SESSION_ID, "left_semi")


def session_profile(
    cohort: DataFrame, pageviews: DataFrame, stats: list[Column], start: TimeBound = None, end: TimeBound = None
) -> DataFrame:
    """One row per cohort session with ``stats``, aggregates over its pageviews.

    Cohort rows and pageviews are one set of rows, grouped by session once; a cohort row
    has NULL in the pageviews' columns.  Sessions without pageviews stay, with the value
    that ``stats`` have of NULLs alone, pageviews of other sessions leave after the
    grouping, and a session that is listed twice is one row.  Nothing is joined back.
    """
    views = cohort_pageviews(pageviews, cohort, start, end).where(f"{SESSION_ID} IS NOT NULL")
    # the id under an alias on both sides: only then a union of bucketed scans stays bucketed
    own = f"{SESSION_ID} AS {SESSION_ID}"
    rest = [c for c in views.columns if c not in (SESSION_ID, "_in_cohort")]
    views = views.selectExpr(own, *[f"`{c}`" for c in rest], "CAST(NULL AS BOOLEAN) AS _in_cohort")
    members = cohort.selectExpr(own, "TRUE AS _in_cohort")
    rows = views.unionByName(members, allowMissingColumns=True)
    return rows.groupBy(SESSION_ID).agg(F.max("_in_cohort").alias("_in_cohort"), *stats).where("_in_cohort").drop("_in_cohort")


def session_cohort(
    sessions: DataFrame,
    *,
    utm_source: str | None = None,
    utm_campaign: str | None = None,
    start: TimeBound = None,
    end: TimeBound = None,
    start_exclusive: bool = False,
    end_inclusive: bool = False,
) -> DataFrame:
    """Sessions of one campaign created inside a time window."""
    return within(
        sessions,
        start,
        end,
        start_exclusive=start_exclusive,
        end_inclusive=end_inclusive,
        extra_sql=campaign_filter_sql(utm_source, utm_campaign),
    )
