"""Plan shapes: the operators stay JVM-side, never build Cartesian products,
use no multi-distinct Expand, aggregate map-side, and push filters to the scan."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from sessionscope import operators as ops
from sessionscope.plans.inspect import plan_summary
from sessionscope.plans.registry import QUERIES
from sessionscope.sources.tables import ShopTables
from tests.conftest import DATA_SMALL
from tests.helpers import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cartesian_no_expand(spark, name):
    s = plan_summary(QUERIES[name](spark, DATA_SMALL))
    assert not s["python"], name
    assert not s["cartesian"], name
    assert not s["expand"], name
    # whole tables: no row cap anywhere in a registered query
    assert "Limit" not in s["text"].split("\n\n(")[0], name


@pytest.mark.parametrize(
    "name",
    ["bounce_rate", "bounce_rate_by_landing_page", "weekly_bounce_trend", "session_funnel_flags",
     "session_first_pv_and_count", "variant_conversion"],
)
def test_per_session_steps_hash_aggregate(spark, name):
    text = plan_summary(QUERIES[name](spark, DATA_SMALL))["text"]
    assert "SortAggregate" not in text, name
    assert "HashAggregate" in text


def test_campaign_filter_reaches_below_session_aggregation(spark):
    # utm_* are functions of the session id, so Catalyst filters events before
    # the session aggregation; only created_at stays above it
    text = plan_summary(QUERIES["conversion_rate"](spark, DATA_SMALL))["text"]
    physical = text.split("\n\n(")[0]
    assert "Filter" in physical


def test_filters_and_columns_pushed_to_parquet(spark, tmp_path):
    root = str(tmp_path / "shop")
    ShopTables.from_events(spark, DATA_SMALL).write(root)
    t = ShopTables.from_directory(spark, root)
    s = plan_summary(ops.conversion_by_device(t.sessions, t.orders, end="2024-01-20"))
    pushed = " ".join(s["pushed_filters"])
    assert "created_at" in pushed and "utm_source" in pushed and "utm_campaign" in pushed
    # the sessions scan reads only the columns the operator uses
    assert any("http_referer" not in rs and "device_type" in rs for rs in s["read_schemas"])
    assert "PartitionFilters: [isnotnull(created_date" in s["text"]


def test_bucketed_tables_co_locate_per_session_work(spark):
    from tests.conftest import DATA_ORACLE
    from tests.helpers import rows

    derived = ShopTables.from_events(spark, DATA_ORACLE)
    derived.save_as_tables("shop_bucketed", buckets=8, mode="overwrite")
    t = ShopTables.from_tables(spark, "shop_bucketed", bucketed_reads=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = [
            (ops.funnel_counts, (t.sessions, t.pageviews), (derived.sessions, derived.pageviews),
             dict(start="2024-01-05", end="2024-01-25")),
            (ops.conversion_by_device, (t.sessions, t.orders), (derived.sessions, derived.orders),
             dict(end="2024-01-20")),
            (ops.bounce_rate_by_landing_page, (t.sessions, t.pageviews), (derived.sessions, derived.pageviews),
             dict(end="2024-01-28")),
        ]
        for op, bucketed_args, derived_args, kw in cases:
            df = op(*bucketed_args, **kw)
            tree = plan_summary(df)["text"].split("\n\n(")[0]
            # only the final small aggregation shuffles; the per-session
            # aggregation and the session join read the bucketing
            assert tree.count("Exchange") == 1, op.__name__
            assert rows(df) == rows(op(*derived_args, **kw)), op.__name__
        # the default is the shuffle (skew-spreading) plan, same rows
        plain = ShopTables.from_tables(spark, "shop_bucketed")
        df = ops.funnel_counts(plain.sessions, plain.pageviews, start="2024-01-05", end="2024-01-25")
        assert plan_summary(df)["text"].split("\n\n(")[0].count("Exchange") > 1
        assert rows(df) == rows(ops.funnel_counts(t.sessions, t.pageviews, start="2024-01-05", end="2024-01-25"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    ["test_landing_pages", "bounce_rate_by_landing_page", "weekly_bounce_trend", "session_first_pv_and_count",
     "session_landing_details", "session_funnel_flags", "bounce_rate"],
)
def test_cohort_filter_stands_below_the_grouping_by_session(spark, tmp_path, name):
    """Tables of which nothing is known: only the cohort's pageviews are grouped."""
    root = str(tmp_path / "shop")
    ShopTables.from_events(spark, DATA_SMALL).write(root)
    names = ("website_sessions", "website_pageviews", "shop_orders")
    plain = ShopTables.from_parquet(spark, *(f"{root}/{n}" for n in names))
    tree = plan_summary(QUERIES[name].on(plain))["text"].split("\n\n(")[0]
    lines = tree.splitlines()
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
    semi = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    assert semi, tree
    # an aggregate stands above the semi join before the first exchange above it
    above = next(
        x for i in semi for x in reversed(lines[:i]) if ("Aggregate" in x or "Union" in x or "Exchange hash" in x)
    )
    assert "Aggregate" in above or "Union" in above, tree


PROFILES = [
    "test_first_pageviews", "test_landing_pages", "test_bounced_sessions", "bounce_rate_by_landing_page",
    "session_first_pv_and_count", "session_landing_details", "weekly_bounce_trend", "session_funnel_flags",
    "funnel_counts", "funnel_rates",
]


@pytest.mark.parametrize("name", PROFILES)
def test_one_exchange_by_session_and_no_join(spark, tmp_path, name):
    """Over the stored layout the cohort is read once and meets its pageviews in one grouping."""
    root = str(tmp_path / "shop")
    ShopTables.from_events(spark, DATA_SMALL).write(root)
    text = plan_summary(QUERIES[name].on(ShopTables.from_directory(spark, root)))["text"]
    main = text.split("===== Subqueries")[0]
    assert "Join" not in main
    assert sum("hashpartitioning(website_session_id" in x for x in main.splitlines()) == 1
    assert len([x for x in main.splitlines() if "Location:" in x and "website_sessions" in x]) == 1


@pytest.mark.parametrize("name", [*PROFILES, "funnel_pageview_flags"])
def test_a_window_on_sessions_prunes_the_pageviews(spark, tmp_path, name):
    root = str(tmp_path / "shop")
    ShopTables.from_events(spark, DATA_SMALL).write(root)
    text = plan_summary(QUERIES[name].on(ShopTables.from_directory(spark, root)))["text"].split("===== Subqueries")[0]
    scans = [x for x in text.split("\n\n") if "Scan parquet" in x and "website_pageviews" in x]
    assert scans and all("PartitionFilters" in x and "session_date" in x for x in scans), text


def test_a_pageview_months_later_still_counts(spark, tmp_path):
    from tests.helpers import shop

    t = shop(
        spark,
        sessions=[(1, "2024-01-10 00:00:00", "gsearch", "nonbrand", "desktop", None), (2, "2024-01-10 00:00:00", "gsearch", "nonbrand", "desktop", None)],
        pageviews=[(1, "2024-01-10 00:00:00", 1, "/home"), (2, "2024-01-10 00:00:00", 2, "/home"), (3, "2024-05-10 00:00:00", 1, "/cart")],
    )
    assert ops.bounce_rate(t.pageviews, end="2024-01-22").first()["bounced_sessions"] == 1
    kw = dict(start="2024-01-05", end="2024-01-25")
    assert ops.funnel_counts(t.sessions, t.pageviews, **kw).first()["to_cart"] == 1
    # stored by the day of its session, it is read with that day
    t.write(str(tmp_path / "shop"))
    stored = ShopTables.from_directory(spark, str(tmp_path / "shop"))
    assert {str(r.session_date) for r in stored.pageviews.collect()} == {"2024-01-10"}
    assert ops.bounce_rate(stored.pageviews, end="2024-01-22").first()["bounced_sessions"] == 1
    assert ops.funnel_counts(stored.sessions, stored.pageviews, **kw).first()["to_cart"] == 1
    assert ops.weekly_bounce_trend(stored.sessions, stored.pageviews, **kw, include_counts=True).first()["bounced_sessions"] == 1


@pytest.mark.parametrize(
    "name",
    ["top_traffic_sources", "conversion_rate", "weekly_session_trend", "conversion_by_device", "weekly_sessions_by_device",
     "weekly_sessions_orders", "hourly_weekday_profile", "weekly_sources", "source_mobile_share",
     "conversion_by_device_source", "weekly_source_device_ratio", "monthly_channel_mix"],
)
def test_session_bounds_reach_the_event_scan(spark, name):
    pushed = " ".join(plan_summary(QUERIES[name](spark, DATA_SMALL))["pushed_filters"])
    assert "LessThan" in pushed and "(ts," in pushed


def test_sessions_at_both_edges_of_the_window(spark):
    t = dt.datetime
    events = [
        (1, t(2024, 1, 4, 23, 59, 59), 1, "view", 0.0, None),  # the day before the window
        (2, t(2024, 1, 5, 0, 0, 0), 2, "view", 0.0, None),
        (3, t(2024, 1, 5, 10, 0, 0), 3, "view", 0.0, None),
        (4, t(2024, 1, 24, 23, 0, 0), 4, "view", 0.0, None),
        (5, t(2024, 1, 25, 0, 0, 0), 5, "view", 0.0, None),  # at the upper bound
        (6, t(2024, 1, 24, 1, 0, 0), 6, "view", 0.0, None),
        (7, t(2024, 1, 24, 23, 59, 59), 6, "purchase", 1.0, None),
        (8, t(2024, 1, 5, 0, 30, 0), 7, "view", 0.0, None),  # starts before a bound inside its day
        (9, t(2024, 1, 5, 12, 0, 0), 7, "view", 0.0, None),
    ]
    from sessionscope.functions.timebuckets import within
    from sessionscope.sources.schemas import EVENTS_SCHEMA

    derived = ShopTables.from_events_frame(spark.createDataFrame(events, EVENTS_SCHEMA)).sessions
    plain = derived.select("*")  # a frame that carries no events
    for kw in (
        dict(start="2024-01-05", end="2024-01-25"),
        dict(start="2024-01-05", end="2024-01-25", start_exclusive=True, end_inclusive=True),
        dict(start="2024-01-05 01:00:00", end="2024-01-24 23:30:00"),
        dict(end="2024-01-05"),
    ):
        assert rows(within(derived, **kw)) == rows(within(plain, **kw))


def test_an_unrelated_created_date_prunes_nothing(spark):
    t = ShopTables.from_events(spark, DATA_SMALL)
    odd = t.sessions.withColumn("created_date", F.lit("2099-01-01").cast("date"))
    assert rows(ops.top_traffic_sources(odd, end="2024-01-20")) == rows(ops.top_traffic_sources(t.sessions, end="2024-01-20"))


def test_every_query_sees_a_file_added_to_a_partition_folder(spark, tmp_path):
    root = tmp_path / "data" / "events.parquet"
    (root / "d=1").mkdir(parents=True)
    shutil.copy(f"{DATA_SMALL}/events.parquet", root / "d=1" / "a.parquet")
    data = str(tmp_path / "data")
    before = {name: rows(query(spark, data)) for name, query in QUERIES.items()}
    more = spark.read.parquet(f"{DATA_SMALL}/events.parquet").withColumns(
        {"event_id": F.col("event_id") + 1_000_000, "user_id": F.col("user_id") + 50_001}
    )
    more.coalesce(1).write.parquet(str(tmp_path / "more"))
    shutil.copy(next((tmp_path / "more").glob("part-*.parquet")), root / "d=1" / "b.parquet")
    fixed = {"page_launch", "variant_launch"}  # the first id stays the first
    for name, query in QUERIES.items():
        after = rows(query(spark, data))
        assert name in fixed or after != before[name], name
