"""Landing-page test (/home against a new lander) and the weekly landing trend.

The launch of the new page is found by the data (first pageview id of the
page) and enters the plan as a scalar subquery, evaluated once by Spark; the
result is not copied by hand.  The cohort's rows and the pageviews are grouped by
session together, so nothing is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.facts import FACTS, each_session_once, first_after, first_on, holds_facts
from sessionscope.functions.metrics import ratio
from sessionscope.functions.timebuckets import TimeBound, yearweek_sunday
from sessionscope.operators.common import session_cohort, session_profile, sql_string
from sessionscope.operators.pages import landing_stats, with_landing_page
from sessionscope.sources.schemas import PAGEVIEW_ID, SESSION_ID

HOME_PAGE, NEW_LANDER = "/home", "/lander-1"


@dataclass(frozen=True)
class LandingTest:
    """A landing test: sessions of one campaign before ``end``, with pageviews
    after the first one of ``launch_page``, landing on one of ``variants``."""

    launch_page: str = NEW_LANDER
    variants: tuple[str, ...] = (HOME_PAGE, NEW_LANDER)
    utm_source: str = "gsearch"
    utm_campaign: str = "nonbrand"
    end: TimeBound = "2012-07-28"

    def profile(self, sessions: DataFrame, pageviews: DataFrame) -> DataFrame:
        """Per test session: first pageview id after the launch, its URL when it
        is a variant, and the session's total pageviews."""
        cohort = session_cohort(
            sessions, utm_source=self.utm_source, utm_campaign=self.utm_campaign, end=self.end
        )
        if holds_facts(cohort):
            first = first_after(cohort, self.launch_page)
            return each_session_once(cohort).select(
                SESSION_ID,
                first.id.alias("first_pageview_id"),
                F.when(first.url.isin(list(self.variants)), first.url).alias("landing_page"),
                F.col(f"{FACTS}.n").alias("count_of_pages_viewed"),
            ).filter("first_pageview_id IS NOT NULL")
        launch = launch_pageview_id(pageviews, self.launch_page)
        # the launch id is compared once per row
        rows = pageviews.withColumn("_after", F.when(F.col(PAGEVIEW_ID) > launch, F.col(PAGEVIEW_ID)))
        profile = session_profile(cohort, rows, landing_stats(self.variants, "_after"), end=self.end)
        return with_landing_page(profile, self.variants).filter("first_pageview_id IS NOT NULL")

    def landings(self, sessions: DataFrame, pageviews: DataFrame) -> DataFrame:
        return self.profile(sessions, pageviews).filter("landing_page IS NOT NULL")


def page_launch(pageviews: DataFrame, *, page: str = NEW_LANDER) -> DataFrame:
    """First time and first pageview id of a page.

    Out: first_created_at, first_pageview_id (NULLs when never seen).
    """
    return pageviews.filter(f"pageview_url = {sql_string(page)} AND created_at IS NOT NULL").agg(
        F.min("created_at").alias("first_created_at"),
        F.min(PAGEVIEW_ID).alias("first_pageview_id"),
    )


def launch_pageview_id(pageviews: DataFrame, page: str = NEW_LANDER) -> Column:
    """Scalar-subquery column: the first pageview id of ``page`` (the
    ``first_pageview_id`` of :func:`page_launch`)."""
    return (
        pageviews.filter(f"pageview_url = {sql_string(page)} AND created_at IS NOT NULL")
        .agg(F.min(PAGEVIEW_ID))
        .scalar()
    )


def test_first_pageviews(sessions: DataFrame, pageviews: DataFrame, **test) -> DataFrame:
    """First pageview id after the launch, per cohort session (parameters: :class:`LandingTest`).

    Out: website_session_id, min_pageview_id.
    """
    profile = LandingTest(**{"variants": (), **test}).profile(sessions, pageviews)
    return profile.select(SESSION_ID, F.col("first_pageview_id").alias("min_pageview_id"))


def test_landing_pages(sessions: DataFrame, pageviews: DataFrame, **test) -> DataFrame:
    """Test sessions that landed on one of the variants (parameters: :class:`LandingTest`).

    Out: website_session_id, landing_page.
    """
    return LandingTest(**test).landings(sessions, pageviews).select(SESSION_ID, "landing_page")


def test_bounced_sessions(sessions: DataFrame, pageviews: DataFrame, **test) -> DataFrame:
    """Test sessions with one pageview in total (parameters: :class:`LandingTest`).

    Out: website_session_id, landing_page, count_of_pages_viewed.
    """
    return (
        LandingTest(**test)
        .landings(sessions, pageviews)
        .filter("count_of_pages_viewed = 1")
        .select(SESSION_ID, "landing_page", "count_of_pages_viewed")
    )


def test_bounce_markers(sessions: DataFrame, pageviews: DataFrame, **test) -> DataFrame:
    """Every test session with its id again when it bounced, else NULL (parameters: :class:`LandingTest`).

    Out: landing_page, website_session_id, bounced_website_session_id.
    """
    return (
        LandingTest(**test)
        .landings(sessions, pageviews)
        .selectExpr(
            "landing_page",
            SESSION_ID,
            f"CASE WHEN count_of_pages_viewed = 1 THEN {SESSION_ID} END AS bounced_website_session_id",
        )
        .orderBy(SESSION_ID)
    )


def bounce_rate_by_landing_page(sessions: DataFrame, pageviews: DataFrame, **test) -> DataFrame:
    """Sessions, bounced sessions and bounce rate per variant (parameters: :class:`LandingTest`).

    Out: landing_page, sessions, bounced_sessions, bounce_rate.
    """
    # one row per session, so plain counts are distinct counts
    return (
        LandingTest(**test)
        .landings(sessions, pageviews)
        .groupBy("landing_page")
        .agg(
            F.count(SESSION_ID).alias("sessions"),
            F.count_if(F.col("count_of_pages_viewed") == 1).alias("bounced_sessions"),
        )
        .select(
            "landing_page",
            "sessions",
            "bounced_sessions",
            ratio("bounced_sessions", "sessions").alias("bounce_rate"),
        )
    )


def _trend_profile(sessions, pageviews, utm_source, utm_campaign, start, end, *stats: Column, stored=()) -> DataFrame:
    """First id, number and further ``stats`` of each cohort session's pageviews;
    sessions without pageviews keep NULL stats and a count of 0.  ``stored`` are the
    same further stats as stored facts have them."""
    # start <= created_at <= end (the end day keeps only its midnight instant)
    cohort = session_cohort(
        sessions, utm_source=utm_source, utm_campaign=utm_campaign, start=start, end=end, end_inclusive=True
    )
    if holds_facts(cohort):
        known = [F.col(f"{FACTS}.first.id").alias("first_pageview_id"), F.col(f"{FACTS}.n").alias("count_pageviews")]
        return each_session_once(cohort).select(SESSION_ID, *known, *stored)
    first = [F.min(PAGEVIEW_ID).alias("first_pageview_id"), F.count(PAGEVIEW_ID).alias("count_pageviews")]
    return session_profile(cohort, pageviews, [*first, *stats], start, end)


def session_first_pv_and_count(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-06-01",
    end: TimeBound = "2012-08-31",
) -> DataFrame:
    """First pageview id and pageview count of every cohort session
    (``start <= created_at <= end``); sessions without pageviews stay, with
    NULL id and count 0.

    Out: website_session_id, first_pageview_id, count_pageviews.
    """
    return _trend_profile(sessions, pageviews, utm_source, utm_campaign, start, end)


def session_landing_details(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-06-01",
    end: TimeBound = "2012-08-31",
) -> DataFrame:
    """Cohort sessions with first pageview, count, landing URL and its time.

    The landing URL may be any page, so it is taken with ``min_by`` over
    (url, time) ordered by pageview id.
    Out: website_session_id, first_pageview_id, count_pageviews, landing_page,
    session_created_at.
    """
    first = F.min_by(F.struct("pageview_url", "created_at"), F.col(PAGEVIEW_ID)).alias("first_pv")
    stored = [F.struct(F.col(f"{FACTS}.first.url").alias("pageview_url"), F.col(f"{FACTS}.first.at").alias("created_at")).alias("first_pv")]
    return _trend_profile(sessions, pageviews, utm_source, utm_campaign, start, end, first, stored=stored).select(
        SESSION_ID,
        "first_pageview_id",
        "count_pageviews",
        F.col("first_pv.pageview_url").alias("landing_page"),
        F.col("first_pv.created_at").alias("session_created_at"),
    )


def weekly_bounce_trend(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-06-01",
    end: TimeBound = "2012-08-31",
    pages: tuple[str, str] = (HOME_PAGE, NEW_LANDER),
    include_counts: bool = False,
) -> DataFrame:
    """Weekly (YEARWEEK of the landing time) bounce rate and sessions per
    landing page; sessions without pageviews form a NULL week.

    Only "landed on page p" for the two pages is needed, so the per-session
    step keeps fixed-width buffers (hash aggregation): the first pageview's
    time via ``min_by(created_at, id)`` and the first id on each page.
    Out: week_start_date, bounce_rate, home_sessions, lander_sessions
    (+ year_week, total_sessions, bounced_sessions with ``include_counts``).
    """
    stored = [F.col(f"{FACTS}.first.at").alias("session_created_at")] if holds_facts(sessions) else []
    stored += [first_on(sessions, p).alias(f"_first_{i}") for i, p in enumerate(pages) if holds_facts(sessions)]
    details = _trend_profile(
        sessions,
        pageviews,
        utm_source,
        utm_campaign,
        start,
        end,
        F.min_by(F.col("created_at"), F.col(PAGEVIEW_ID)).alias("session_created_at"),
        *[
            F.expr(f"min(CASE WHEN pageview_url = {sql_string(p)} THEN {PAGEVIEW_ID} END)").alias(f"_first_{i}")
            for i, p in enumerate(pages)
        ],
        stored=stored,
    )
    # one row per session, so plain counts are distinct counts
    landed_on = lambda i: F.count_if(F.col(f"_first_{i}") == F.col("first_pageview_id"))
    weekly = details.groupBy(yearweek_sunday("session_created_at").alias("year_week")).agg(
        F.min(F.to_date("session_created_at")).alias("week_start_date"),
        F.count(SESSION_ID).alias("total_sessions"),
        F.count_if(F.col("count_pageviews") == 1).alias("bounced_sessions"),
        landed_on(0).alias("home_sessions"),
        landed_on(1).alias("lander_sessions"),
    )
    cols = ["week_start_date"]
    if include_counts:
        cols = ["year_week", "week_start_date", "total_sessions", "bounced_sessions"]
    cols += [
        ratio("bounced_sessions", "total_sessions").alias("bounce_rate"),
        "home_sessions",
        "lander_sessions",
    ]
    return weekly.orderBy("year_week").select(*cols)


# the landing-test operators are named after the analysis, not pytest tests
for _op in (test_first_pageviews, test_landing_pages, test_bounced_sessions, test_bounce_markers):
    _op.__test__ = False
