"""Invariants over the whole sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

from sessionscope import operators as ops
from sessionscope.sources.tables import ShopTables
from tests.conftest import DATA_ORACLE
from tests.helpers import rows


@pytest.fixture(scope="module")
def shop(spark):
    return ShopTables.from_events(spark, DATA_ORACLE)


def test_devices_add_up_to_total(shop):
    for r in ops.weekly_sessions_by_device(shop.sessions, start="2024-01-01", end="2024-01-31").collect():
        assert r["desktop_sessions"] + r["mobile_sessions"] == r["total_sessions"]


def test_bounced_never_exceed_sessions(shop):
    for r in ops.bounce_rate_by_landing_page(shop.sessions, shop.pageviews, end="2024-01-31").collect():
        assert 0 <= r["bounced_sessions"] <= r["sessions"]
        assert 0.0 <= r["bounce_rate"] <= 1.0
    r = ops.bounce_rate(shop.pageviews, end="2024-01-31").first()
    assert 0 <= r["bounced_sessions"] <= r["sessions"]


def test_channel_groups_partition_the_sessions(shop):
    classified = ops.classify_channel(shop.sessions)
    per_group = classified.groupBy("channel_group").count().collect()
    assert sum(r["count"] for r in per_group) == shop.sessions.count()
    assert {r["channel_group"] for r in per_group} == {
        "organic_search", "paid_nonbrand", "paid_brand", "direct_type_in", None
    }


def test_key_counts_equal_distinct_counts(shop):
    # the fused form (count of a unique key) equals COUNT(DISTINCT) with Expand
    s = shop.sessions.filter("created_at < '2024-01-31'")
    fused = s.groupBy("device_type").agg(
        F.count("website_session_id").alias("n"),
        F.count(F.when(F.col("utm_source") == "gsearch", F.col("website_session_id"))).alias("g"),
    )
    naive = s.groupBy("device_type").agg(
        F.count_distinct("website_session_id").alias("n"),
        F.count_distinct(F.when(F.col("utm_source") == "gsearch", F.col("website_session_id"))).alias("g"),
    )
    assert rows(fused) == rows(naive)


def test_min_by_equals_join_back(shop):
    pv = shop.pageviews.filter("created_at < '2024-01-20'")
    first = pv.groupBy("website_session_id").agg(F.min("website_pageview_id").alias("m"))
    join_back = (
        first.join(pv, first["m"] == pv["website_pageview_id"])
        .groupBy(F.col("pageview_url").alias("landing_page_url"))
        .agg(F.count("*").alias("sessions_hitting_page"))
    )
    assert rows(ops.top_entry_pages(shop.pageviews, end="2024-01-20")) == rows(join_back)


def test_funnel_reached_counts_match_flags(shop):
    kw = dict(start="2024-01-05", end="2024-01-25")
    flags = ops.session_funnel_flags(shop.sessions, shop.pageviews, **kw)
    counts = ops.funnel_counts(shop.sessions, shop.pageviews, **kw).first()
    assert counts["sessions"] == flags.count()
    assert counts["to_thankyou"] == flags.filter("thankyou_made_it = 1").count()
    rates = ops.funnel_rates(shop.sessions, shop.pageviews, **kw).first()
    assert rates["lander_click_rt"] == pytest.approx(counts["to_products"] / counts["sessions"])


def test_orders_counted_once_per_order(shop):
    r = ops.conversion_rate(shop.sessions, shop.orders, end="2024-01-31").first()
    cohort = shop.sessions.filter(
        "utm_source = 'gsearch' AND utm_campaign = 'nonbrand' AND created_at < '2024-01-31'"
    )
    want = shop.orders.join(cohort, "website_session_id", "left_semi").count()
    assert r["total_orders"] == want
    assert r["total_sessions"] == cohort.count()
