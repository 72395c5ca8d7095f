"""Hand-made micro tables with answers worked out by hand."""

import datetime as dt

import pytest

from sessionscope import operators as ops
from tests.helpers import rows, shop

D = dt.date
T = dt.datetime

# New-Year fixture: two orders in session 1, midnight instants on 2013-01-01
# and 2013-01-06, a session one second after midnight.
NEW_YEAR_SESSIONS = [
    (1, "2012-12-30 10:00:00", "gsearch", "nonbrand", "desktop", "https://www.gsearch.com"),
    (2, "2012-12-31 09:00:00", "gsearch", "nonbrand", "mobile", "https://www.gsearch.com"),
    (3, "2013-01-01 00:00:00", "gsearch", "nonbrand", "desktop", "https://www.gsearch.com"),
    (4, "2013-01-05 23:59:00", "bsearch", "nonbrand", "desktop", "https://www.bsearch.com"),
    (5, "2013-01-06 00:00:00", "gsearch", "nonbrand", "desktop", "https://www.gsearch.com"),
    (6, "2013-01-06 00:00:01", "socialbook", "pilot", "desktop", "https://www.socialbook.com"),
]
NEW_YEAR_ORDERS = [(1, "2012-12-30 10:05:00", 1), (2, "2012-12-30 10:09:00", 1), (3, "2013-01-06 00:10:00", 5)]


@pytest.fixture(scope="module")
def new_year(spark):
    return shop(spark, NEW_YEAR_SESSIONS, orders=NEW_YEAR_ORDERS)


def test_year_week_split_over_new_year(new_year):
    got = rows(ops.weekly_sessions_by_device(new_year.sessions, start="2012-12-01", end="2013-02-01"))
    assert got == [
        (2012, 53, D(2012, 12, 30), 1, 1, 2),
        (2013, 0, D(2013, 1, 1), 1, 0, 1),
        (2013, 1, D(2013, 1, 6), 1, 0, 1),
    ]


def test_weekly_sessions_orders_counts_each_order_once(new_year):
    got = rows(ops.weekly_sessions_orders(new_year.sessions, new_year.orders, end="2013-02-01"))
    assert got == [
        (2012, 53, D(2012, 12, 30), 2, 2),
        (2013, 0, D(2013, 1, 1), 2, 0),
        (2013, 1, D(2013, 1, 6), 2, 1),
    ]


def test_yearweek_keeps_new_year_week_whole(new_year):
    got = rows(ops.weekly_sources(new_year.sessions, start="2012-12-01", end="2013-02-01"))
    assert got == [(201253, D(2012, 12, 30), 4, 3, 1), (201301, D(2013, 1, 6), 1, 1, 0)]


def test_conversion_with_several_orders_per_session(new_year):
    assert rows(ops.conversion_rate(new_year.sessions, new_year.orders, end="2013-02-01")) == [(4, 3, 75.0)]
    got = rows(ops.conversion_by_device(new_year.sessions, new_year.orders, end="2013-02-01"))
    assert got == [("desktop", 3, 3, 1.0), ("mobile", 1, 0, 0.0)]


def test_zero_divisor_gives_null(new_year):
    got = rows(ops.weekly_source_device_ratio(new_year.sessions, start="2012-12-01", end="2013-02-01"))
    assert got == [
        (201253, D(2012, 12, 30), 2, 1, 0.5, 1, 0, 0.0),
        (201301, D(2013, 1, 6), 1, 0, 0.0, 0, 0, None),
    ]


def test_between_keeps_only_midnight_of_last_day(new_year):
    got = rows(ops.hourly_weekday_profile(new_year.sessions, start="2013-01-01", end="2013-01-06"))
    assert got == [
        (0, 1.0, None, 1.0, None, None, None, None, 1.0),
        (23, 1.0, None, None, None, None, None, 1.0, None),
    ]


def test_open_lower_bound_excludes_the_instant(new_year):
    got = rows(
        ops.weekly_sessions_by_device(new_year.sessions, start="2012-12-31 09:00:00", end="2013-02-01")
    )
    assert [r[:2] + r[3:] for r in got] == [(2013, 0, 1, 0, 1), (2013, 1, 1, 0, 1)]


def test_empty_input_global_aggregates(new_year, spark):
    empty = shop(spark)
    assert rows(ops.conversion_rate(new_year.sessions, new_year.orders, end="2000-01-01")) == [(0, 0, None)]
    assert rows(ops.bounce_rate(empty.pageviews, end="2030-01-01")) == [(0, 0, None)]
    assert rows(ops.funnel_counts(empty.sessions, empty.pageviews, start="2000-01-01", end="2030-01-01")) == [
        (0, 0, 0, 0, 0, 0, 0)
    ]
    assert rows(ops.funnel_rates(empty.sessions, empty.pageviews, start="2000-01-01", end="2030-01-01")) == [
        (None,) * 6
    ]
    assert rows(ops.top_traffic_sources(empty.sessions, end="2030-01-01")) == []


# Channel fixture: NULL attributes, every channel class and one unclassified.
CHANNEL_SESSIONS = [
    (20, "2024-01-02 10:00:00", "gsearch", "nonbrand", "desktop", "https://www.gsearch.com"),
    (21, "2024-01-03 10:00:00", None, None, "desktop", "https://www.gsearch.com"),
    (22, "2024-01-04 10:00:00", "gsearch", "brand", "mobile", "https://www.gsearch.com"),
    (23, "2024-01-05 10:00:00", None, None, "desktop", None),
    (24, "2024-01-06 10:00:00", "socialbook", "pilot", "desktop", "https://www.socialbook.com"),
    (25, "2024-02-01 10:00:00", "bsearch", "nonbrand", "desktop", "https://www.bsearch.com"),
]


def test_channel_classes_and_null_groups(spark):
    t = shop(spark, CHANNEL_SESSIONS)
    classes = {r[0]: r[2] for r in rows(ops.classify_channel(t.sessions))}
    assert classes == {
        20: "paid_nonbrand", 21: "organic_search", 22: "paid_brand",
        23: "direct_type_in", 24: None, 25: "paid_nonbrand",
    }
    assert rows(ops.monthly_channel_mix(t.sessions, end="2024-03-01")) == [
        (2024, 1, 1, 1, 1.0, 1, 1.0, 1, 1.0),
        (2024, 2, 1, 0, 0.0, 0, 0.0, 0, 0.0),
    ]
    sources = rows(ops.top_traffic_sources(t.sessions, end="2024-03-01"))
    assert (None, None, None, 1) in sources
    assert (None, None, "https://www.gsearch.com", 1) in sources
    assert len(sources) == 6


# Pageview fixture: /lander-1 launches at id 102, /billing-2 at id 105;
# session 12 has no pageviews; session 13 has a pageview after the cutoff;
# session 11 sees both billing pages and has two orders.
PV_SESSIONS = [
    (sid, f"2024-01-10 {h:02d}:00:00", "gsearch", "nonbrand", "desktop", "https://www.gsearch.com")
    for sid, h in [(10, 8), (11, 9), (12, 10), (13, 11), (14, 12)]
]
PAGEVIEWS = [
    (100, "2024-01-10 08:00:00", 10, "/home"),
    (101, "2024-01-10 08:01:00", 10, "/products"),
    (102, "2024-01-10 09:00:00", 11, "/lander-1"),
    (103, "2024-01-10 11:00:00", 13, "/home"),
    (104, "2024-01-11 00:00:00", 13, "/products"),
    (105, "2024-01-10 11:30:00", 11, "/billing-2"),
    (106, "2024-01-10 11:40:00", 10, "/billing"),
    (107, "2024-01-10 11:41:00", 11, "/billing"),
    (108, "2024-01-10 11:50:00", 11, "/thank-you-for-your-order"),
    (109, "2024-01-10 12:00:00", 14, "/home"),
]
PV_ORDERS = [(900, "2024-01-10 11:50:00", 11), (901, "2024-01-10 11:55:00", 11)]


@pytest.fixture(scope="module")
def site(spark):
    return shop(spark, PV_SESSIONS, PAGEVIEWS, PV_ORDERS)


def test_bounce_chain_recounts_all_pageviews(site):
    pv = site.pageviews
    assert rows(ops.sessions_with_landing_page(pv, end="2024-01-11")) == [(10, "/home"), (13, "/home"), (14, "/home")]
    assert rows(ops.bounced_sessions(pv, end="2024-01-11")) == [(14, "/home", 1)]
    assert rows(ops.bounce_markers(pv, end="2024-01-11"), order_insensitive=False) == [(10, None), (13, None), (14, 14)]
    assert rows(ops.bounce_rate(pv, end="2024-01-11")) == [(3, 1, round(1 / 3, 9))]


def test_entry_pages_and_first_pageviews(site):
    pv = site.pageviews
    assert rows(ops.top_entry_pages(pv, end="2024-01-11")) == [("/home", 3), ("/lander-1", 1)]
    assert rows(ops.first_pageview_per_session(pv, end="2024-01-11")) == [(10, 100), (11, 102), (13, 103), (14, 109)]
    assert rows(ops.top_pages(pv, end="2024-01-11"))[0] == ("/billing", 2)


def test_landing_test_chain(site):
    s, pv = site.sessions, site.pageviews
    assert rows(ops.page_launch(pv)) == [(T(2024, 1, 10, 9), 102)]
    assert rows(ops.test_first_pageviews(s, pv, end="2024-01-11")) == [(10, 106), (11, 105), (13, 103), (14, 109)]
    assert rows(ops.test_landing_pages(s, pv, end="2024-01-11")) == [(13, "/home"), (14, "/home")]
    assert rows(ops.test_bounced_sessions(s, pv, end="2024-01-11")) == [(14, "/home", 1)]
    assert rows(ops.test_bounce_markers(s, pv, end="2024-01-11"), order_insensitive=False) == [
        ("/home", 13, None), ("/home", 14, 14)
    ]
    assert rows(ops.bounce_rate_by_landing_page(s, pv, end="2024-01-11")) == [("/home", 2, 1, 0.5)]


def test_landing_trend_keeps_sessions_without_pageviews(site):
    s, pv = site.sessions, site.pageviews
    kw = dict(start="2024-01-10", end="2024-01-11")
    assert rows(ops.session_first_pv_and_count(s, pv, **kw)) == [
        (10, 100, 3), (11, 102, 4), (12, None, 0), (13, 103, 2), (14, 109, 1)
    ]
    details = rows(ops.session_landing_details(s, pv, **kw))
    assert details[2] == (12, None, 0, None, None)
    assert details[1] == (11, 102, 4, "/lander-1", T(2024, 1, 10, 9))
    trend = rows(ops.weekly_bounce_trend(s, pv, **kw))
    assert trend == [(None, 0.0, 0, 0), (D(2024, 1, 10), 0.25, 3, 1)]
    full = rows(ops.weekly_bounce_trend(s, pv, include_counts=True, **kw))
    assert full == [(202401, D(2024, 1, 10), 4, 1, 0.25, 3, 1), (None, None, 1, 0, 0.0, 0, 0)]


def test_funnel(site):
    s, pv = site.sessions, site.pageviews
    kw = dict(start="2024-01-09", end="2024-01-11")
    flags = rows(ops.funnel_pageview_flags(s, pv, **kw), order_insensitive=False)
    assert len(flags) == 11
    assert (12, None, None, 0, 0, 0, 0, 0, 0) in flags
    assert [r[0] for r in flags] == sorted(r[0] for r in flags)
    assert rows(ops.session_funnel_flags(s, pv, **kw)) == [
        (10, 1, 0, 0, 0, 1, 0), (11, 0, 0, 0, 0, 1, 1), (12, 0, 0, 0, 0, 0, 0),
        (13, 1, 0, 0, 0, 0, 0), (14, 0, 0, 0, 0, 0, 0),
    ]
    assert rows(ops.funnel_counts(s, pv, **kw)) == [(5, 2, 0, 0, 0, 2, 1)]
    assert rows(ops.funnel_rates(s, pv, **kw)) == [(0.4, 0.0, None, None, None, 0.5)]


def test_variant_test_counts_a_session_in_both_groups(site):
    pv, o = site.pageviews, site.orders
    assert rows(ops.variant_launch(pv)) == [(105,)]
    assert rows(ops.variant_sessions_orders(pv, o, end="2024-01-11")) == [
        (10, "/billing", None), (11, "/billing", 900), (11, "/billing", 901),
        (11, "/billing-2", 900), (11, "/billing-2", 901),
    ]
    assert rows(ops.variant_conversion(pv, o, end="2024-01-11")) == [("/billing", 2, 2, 1.0), ("/billing-2", 1, 2, 2.0)]
