"""Website pages: most viewed pages, entry (landing) pages and bounce rates.

The landing page of a session is the URL of its smallest pageview id among the
pageviews in the analysis window; a bounce is a session with exactly one
pageview *in total* (all its pageviews count, also those outside the window).

Only the window's pageviews are grouped by session; the pageviews outside it are
read for the landed sessions alone (a semi join before their grouping), and the
two counts are added.  The landing page is the candidate whose first id equals
the session's first id (ids are unique), so all buffers are fixed-width longs and
Spark plans a hash aggregate with a map-side partial step.  When the landing URL
itself is the output (any URL), ``min_by(url, id)`` is used instead; its string
buffer makes Spark sort-aggregate, still one shuffle and spill-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.facts import FACTS, VARIANT, holds_facts
from sessionscope.functions.metrics import distinct_counts, ratio
from sessionscope.functions.timebuckets import TimeBound, time_window, time_window_sql, within
from sessionscope.operators.common import sql_string
from sessionscope.sources.schemas import PAGEVIEW_ID, SESSION_ID


def landing_stats(candidates: tuple[str, ...], window_id: str = PAGEVIEW_ID) -> list[Column]:
    """Aggregates of a session's pageviews for :func:`with_landing_page`.

    ``window_id`` is the column that holds the pageview id of the rows that can be
    the landing (NULL for others).
    """
    return [
        F.min(window_id).alias("first_pageview_id"),
        F.count(PAGEVIEW_ID).alias("count_of_pages_viewed"),
        *[
            F.expr(f"min(CASE WHEN pageview_url = {sql_string(p)} THEN {window_id} END)").alias(f"_first_{i}")
            for i, p in enumerate(candidates)
        ],
    ]


def with_landing_page(profile: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """Out: website_session_id, first_pageview_id, landing_page (if a candidate), count_of_pages_viewed."""
    branches = " ".join(
        f"WHEN _first_{i} = first_pageview_id THEN {sql_string(p)}" for i, p in enumerate(candidates)
    )
    landing = f"CASE {branches} END" if candidates else "CAST(NULL AS STRING)"
    return profile.selectExpr(SESSION_ID, "first_pageview_id", f"{landing} AS landing_page", "count_of_pages_viewed")


def landing_profile(pageviews: DataFrame, candidates: tuple[str, ...], window_id: str = PAGEVIEW_ID) -> DataFrame:
    """One row per session of the pageviews, as :func:`with_landing_page` gives it."""
    return with_landing_page(pageviews.groupBy(SESSION_ID).agg(*landing_stats(candidates, window_id)), candidates)


def top_pages(pageviews: DataFrame, *, end: TimeBound = "2012-06-09") -> DataFrame:
    """Pageviews per URL, most viewed first.  Out: pageview_url, pvs."""
    views = within(pageviews, end=end)
    return distinct_counts(views, [F.col("pageview_url")], total="pvs", key=PAGEVIEW_ID).orderBy(F.desc("pvs"))


def first_pageview_per_session(
    pageviews: DataFrame, *, end: TimeBound = "2012-06-12", id_alias: str = "first_pv"
) -> DataFrame:
    """Smallest pageview id per session, over pageviews before ``end``.

    Out: website_session_id, <id_alias> (``first_pv``; ``min_pageview_id`` in
    the bounce-rate variant).
    """
    return (
        within(pageviews, end=end)
        .groupBy(SESSION_ID)
        .agg(F.min(PAGEVIEW_ID).alias(id_alias))
    )


def top_entry_pages(pageviews: DataFrame, *, end: TimeBound = "2012-06-12") -> DataFrame:
    """Sessions per landing page, most frequent first.

    Out: landing_page_url, sessions_hitting_page.
    """
    landing = (
        within(pageviews, end=end)
        .groupBy(SESSION_ID)
        .agg(F.min_by(F.col("pageview_url"), F.col(PAGEVIEW_ID)).alias("landing_page_url"))
    )
    return (
        landing.groupBy("landing_page_url")
        .agg(F.count(SESSION_ID).alias("sessions_hitting_page"))
        .orderBy(F.desc("sessions_hitting_page"))
    )


def _landed_sessions(pageviews: DataFrame, end: TimeBound, landing_page: str) -> DataFrame:
    if holds_facts(pageviews):
        # ids rise with time: the first view before ``end`` is the first one, or there is none
        before = time_window_sql(f"{FACTS}.first.at", end=end)
        return pageviews.filter(f"{VARIANT} = 1 AND {FACTS}.first.url = {sql_string(landing_page)} AND {before}").select(
            SESSION_ID,
            F.col(f"{FACTS}.first.url").alias("landing_page"),
            F.col(f"{FACTS}.n").alias("count_of_pages_viewed"),
        )
    views = within(pageviews, end=end, extra_sql=f"{SESSION_ID} IS NOT NULL")
    landed = landing_profile(views, (landing_page,)).filter("landing_page IS NOT NULL")
    if end is None:
        return landed
    # the landed sessions' pageviews that the window leaves out
    outside = pageviews.filter(~F.coalesce(time_window("created_at", end=end), F.lit(False)))
    later = (
        outside.join(landed.select(SESSION_ID), SESSION_ID, "left_semi")
        .groupBy(SESSION_ID)
        .agg(F.count(PAGEVIEW_ID).alias("_later"))
    )
    return landed.join(later, SESSION_ID, "left").select(
        SESSION_ID,
        "landing_page",
        F.expr("count_of_pages_viewed + coalesce(_later, 0)").alias("count_of_pages_viewed"),
    )


def sessions_with_landing_page(
    pageviews: DataFrame, *, end: TimeBound = "2012-06-14", landing_page: str = "/home"
) -> DataFrame:
    """Sessions whose first pageview before ``end`` is ``landing_page``.

    Out: website_session_id, landing_page.
    """
    return _landed_sessions(pageviews, end, landing_page).select(SESSION_ID, "landing_page")


def bounced_sessions(
    pageviews: DataFrame, *, end: TimeBound = "2012-06-14", landing_page: str = "/home"
) -> DataFrame:
    """Landed sessions with exactly one pageview in total.

    Out: website_session_id, landing_page, count_of_pages_viewed.
    """
    return (
        _landed_sessions(pageviews, end, landing_page)
        .filter("count_of_pages_viewed = 1")
        .select(SESSION_ID, "landing_page", "count_of_pages_viewed")
    )


def bounce_markers(
    pageviews: DataFrame, *, end: TimeBound = "2012-06-14", landing_page: str = "/home"
) -> DataFrame:
    """Every landed session with its id again when it bounced, else NULL.

    Out: website_session_id, bounced_website_session_id (ordered by session).
    """
    return (
        _landed_sessions(pageviews, end, landing_page)
        .selectExpr(
            SESSION_ID,
            f"CASE WHEN count_of_pages_viewed = 1 THEN {SESSION_ID} END AS bounced_website_session_id",
        )
        .orderBy(SESSION_ID)
    )


def bounce_rate(
    pageviews: DataFrame, *, end: TimeBound = "2012-06-14", landing_page: str = "/home"
) -> DataFrame:
    """One row: landed sessions, bounced sessions, bounced / landed.

    Out: sessions, bounced_sessions, bounce_rate.
    """
    # one row per session, so plain counts are distinct counts
    return (
        _landed_sessions(pageviews, end, landing_page)
        .agg(
            F.count(SESSION_ID).alias("sessions"),
            F.count_if(F.col("count_of_pages_viewed") == 1).alias("bounced_sessions"),
        )
        .select("sessions", "bounced_sessions", ratio("bounced_sessions", "sessions").alias("bounce_rate"))
    )
