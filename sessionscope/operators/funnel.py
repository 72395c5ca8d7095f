"""Conversion funnel: which steps each session reached, counts and rates.

A step counts as reached when the session saw its page at any time (the
funnel is unordered, as in the original analysis), so a step-to-step rate can
exceed 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.facts import each_session_once, first_on, holds_facts
from sessionscope.functions.metrics import ratio
from sessionscope.functions.timebuckets import TimeBound
from sessionscope.operators.common import cohort_pageviews, session_cohort, session_profile, sql_string
from sessionscope.plans.joins import hot_key_left_join
from sessionscope.sources.schemas import PAGEVIEW_ID, SESSION_ID


@dataclass(frozen=True)
class FunnelStep:
    url: str
    page_flag: str  # pageview-level 0/1 column
    made_it: str  # session-level 0/1 column
    reached: str  # count of sessions that reached the step
    rate: str  # reached(step) / reached(previous step); the first step is over all sessions


# The shop's funnel pages and output names, in funnel order.
DEFAULT_STEPS = (
    FunnelStep("/products", "products_page", "product_made_it", "to_products", "lander_click_rt"),
    FunnelStep("/the-original-mr-fuzzy", "mrfuzzy_page", "mrfuzzy_made_it", "to_mrfuzzy", "products_to_mrfuzzy"),
    FunnelStep("/cart", "cart_page", "cart_made_it", "to_cart", "mrfuzzy_to_cart"),
    FunnelStep("/shipping", "shipping_page", "shipping_made_it", "to_shipping", "cart_to_shipping"),
    FunnelStep("/billing", "billing_page", "billing_made_it", "to_billing", "shipping_to_billing"),
    FunnelStep("/thank-you-for-your-order", "thankyou_page", "thankyou_made_it", "to_thankyou", "billing_to_thankyou"),
)


def _cohort(sessions, utm_source, utm_campaign, start, end):
    # start < created_at < end, both bounds open
    return session_cohort(
        sessions,
        utm_source=utm_source,
        utm_campaign=utm_campaign,
        start=start,
        end=end,
        start_exclusive=True,
    )


def funnel_pageview_flags(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-08-05",
    end: TimeBound = "2012-09-05",
    steps: tuple[FunnelStep, ...] = DEFAULT_STEPS,
) -> DataFrame:
    """Every pageview of the cohort sessions with one 0/1 flag per step;
    a cohort session without pageviews appears once with NULL page and 0 flags.

    Out: website_session_id, pageview_url, pageview_created_at, <page_flag>…
    ordered by session and pageview time.
    """
    cohort = _cohort(sessions, utm_source, utm_campaign, start, end)
    pvs = cohort_pageviews(pageviews, cohort, start, end).select(
        SESSION_ID, PAGEVIEW_ID, "pageview_url", F.col("created_at").alias("pageview_created_at")
    )
    rows = hot_key_left_join(cohort.select(SESSION_ID), pvs, SESSION_ID, right_id=PAGEVIEW_ID)
    flags = [
        f"CASE WHEN pageview_url = {sql_string(s.url)} THEN 1 ELSE 0 END AS {s.page_flag}"
        for s in steps
    ]
    return rows.selectExpr(SESSION_ID, "pageview_url", "pageview_created_at", *flags).orderBy(
        SESSION_ID, "pageview_created_at"
    )


def session_funnel_flags(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-08-05",
    end: TimeBound = "2012-09-05",
    steps: tuple[FunnelStep, ...] = DEFAULT_STEPS,
) -> DataFrame:
    """Per cohort session, 1 when it saw each step's page, else 0.

    The flags are max-aggregated per session (map-side partial aggregation) over the
    cohort's rows and the pageviews together.
    Out: website_session_id, <made_it>…
    """
    cohort = _cohort(sessions, utm_source, utm_campaign, start, end)
    if holds_facts(cohort):
        seen = [F.when(first_on(cohort, s.url).isNotNull(), 1).otherwise(0).alias(s.made_it) for s in steps]
        return each_session_once(cohort).select(SESSION_ID, *seen)
    reached = [
        F.expr(f"max(CASE WHEN pageview_url = {sql_string(s.url)} THEN 1 ELSE 0 END)").alias(s.made_it) for s in steps
    ]
    return session_profile(cohort, pageviews, reached, start, end)


def funnel_counts(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-08-05",
    end: TimeBound = "2012-09-05",
    steps: tuple[FunnelStep, ...] = DEFAULT_STEPS,
) -> DataFrame:
    """One row: cohort sessions and how many reached each step.

    Out: sessions, <reached>…
    """
    flags = session_funnel_flags(
        sessions, pageviews, utm_source=utm_source, utm_campaign=utm_campaign,
        start=start, end=end, steps=steps,
    )
    return flags.agg(
        F.count(SESSION_ID).alias("sessions"),
        *[F.count_if(F.col(s.made_it) == 1).alias(s.reached) for s in steps],
    )


def funnel_rates(
    sessions: DataFrame,
    pageviews: DataFrame,
    *,
    utm_source: str = "gsearch",
    utm_campaign: str = "nonbrand",
    start: TimeBound = "2012-08-05",
    end: TimeBound = "2012-09-05",
    steps: tuple[FunnelStep, ...] = DEFAULT_STEPS,
) -> DataFrame:
    """One row of step-to-step rates (NULL where the previous step is 0).

    Out: <rate>… (lander_click_rt, products_to_mrfuzzy, …).
    """
    counts = funnel_counts(
        sessions, pageviews, utm_source=utm_source, utm_campaign=utm_campaign,
        start=start, end=end, steps=steps,
    )
    previous = ["sessions"] + [s.reached for s in steps[:-1]]
    return counts.select(*[ratio(s.reached, p).alias(s.rate) for s, p in zip(steps, previous)])
