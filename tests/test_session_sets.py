"""Distinct counts from stored sets against the rows and the twins."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionscope import operators as ops
from sessionscope.plans.inspect import plan_summary
from sessionscope.plans.oracle import oracle_on_shop_tables
from sessionscope.plans.registry import QUERIES, SET_QUERIES
from sessionscope.rollups import build_session_sets, read_session_sets, update_session_sets
from sessionscope.sources.schemas import EVENTS_SCHEMA, ORDERS_SCHEMA, PAGEVIEWS_SCHEMA, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables
from tests.helpers import rows, shop
from tests.test_random_oracle import _arrow, _multiset, random_shop_rows

COUNTING = [
    "top_traffic_sources", "conversion_rate", "weekly_session_trend", "weekly_session_trend_keys", "conversion_by_device",
    "weekly_sessions_by_device", "weekly_sessions_orders", "weekly_sources", "source_mobile_share",
    "conversion_by_device_source", "weekly_source_device_ratio", "monthly_channel_mix",
]


def over(sets):
    return ShopTables(sessions=sets, orders=sets)


@pytest.fixture(scope="module")
def hot_and_repeated(spark, tmp_path_factory):
    """Rows loaded twice, a session with a third of the orders, instants exactly at midnight."""
    tables = random_shop_rows(31, hot_share=1 / 3, repeats=True)
    schemas = (SESSIONS_SCHEMA, PAGEVIEWS_SCHEMA, ORDERS_SCHEMA)
    t = ShopTables(*(spark.createDataFrame(r, s) for r, s in zip(tables, schemas)))
    root = str(tmp_path_factory.mktemp("sets"))
    build_session_sets(t, f"{root}/day", "day")
    build_session_sets(t, f"{root}/hour", "hour")
    con = duckdb.connect()
    for name, r, s in zip(("website_sessions", "website_pageviews", "shop_orders"), tables, schemas):
        con.register(f"{name}_arrow", _arrow(r, s))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return t, root, con


@pytest.mark.parametrize("unit", ["day", "hour"])
def test_every_counting_operator(spark, hot_and_repeated, unit):
    _, root, con = hot_and_repeated
    sets = over(read_session_sets(spark, f"{root}/{unit}", unit))
    for name in COUNTING + (["hourly_weekday_profile"] if unit == "hour" else []):
        got = QUERIES[name].on(sets).toArrow()
        want = con.sql(oracle_on_shop_tables(name)).to_arrow_table()
        columns = sorted(want.column_names)
        assert got.num_rows and _multiset(got, columns) == _multiset(want, columns), name


def test_other_windows_read_the_sets_alone(spark, hot_and_repeated):
    t, root, _ = hot_and_repeated
    sets = read_session_sets(spark, f"{root}/day")
    for end in ("2024-01-03", "2024-01-20", dt.date(2024, 1, 29)):
        df = ops.weekly_session_trend(sets, end=end)
        assert rows(df) == rows(ops.weekly_session_trend(t.sessions, end=end))
    text = plan_summary(df)["text"]
    assert "session_sets_by_day" in text and "PartitionFilters: [isnotnull(created_date" in text
    assert all("session_sets_by_day" in x for x in text.splitlines() if x.startswith("Location:"))


def test_a_window_that_cuts_a_slot_is_refused(spark, hot_and_repeated):
    _, root, _ = hot_and_repeated
    day, hour = (read_session_sets(spark, f"{root}/{u}", u) for u in ("day", "hour"))
    ops.top_traffic_sources(hour, end="2024-01-20 07:00:00")
    for sets, end in ((day, "2024-01-20 07:00:00"), (hour, "2024-01-20 07:30:00")):
        with pytest.raises(ValueError, match="cannot be cut"):
            ops.top_traffic_sources(sets, end=end)


def test_numbers_are_dense_and_kept(spark, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 10:00:00"
    first = [(100 + i, day(1 + i % 5), "gsearch", "nonbrand", "mobile", None) for i in range(50)]
    root = str(tmp_path / "sets")
    build_session_sets(shop(spark, sessions=first, orders=[(1, day(1), 100), (2, day(1), 999)]), root)
    numbers = lambda: {r.website_session_id: r.n for r in spark.read.parquet(f"{root}/session_numbers").collect()}
    before = numbers()
    assert sorted(before.values()) == list(range(1, 51))
    assert sorted(before, key=before.get) == [s for _, s in sorted((r[1], r[0]) for r in first)]
    more = [(7, day(3), None, None, "desktop", None), (8, day(9), "gsearch", "nonbrand", "mobile", None)]
    both = shop(spark, sessions=first + more, orders=[(1, day(1), 100), (2, day(1), 999), (3, day(3), 7)])
    files = lambda d: sorted((tmp_path / "sets" / "session_sets_by_day" / f"created_date=2024-01-{d:02d}").iterdir())
    untouched = files(1)
    update_session_sets(both, root, [dt.date(2024, 1, 3), dt.date(2024, 1, 9)])
    after = numbers()
    assert {k: after[k] for k in before} == before and sorted(after[k] for k in (7, 8)) == [51, 52]
    assert files(1) == untouched and files(9)
    sets = over(read_session_sets(spark, root))
    for op in (ops.conversion_by_device, ops.conversion_rate, ops.conversion_by_device_source):
        kw = {"end": "2024-02-01"}
        assert rows(op(sets.sessions, sets.orders, **kw)) == rows(op(both.sessions, both.orders, **kw))
    assert rows(ops.top_traffic_sources(sets.sessions, end="2024-02-01")) == rows(ops.top_traffic_sources(both.sessions, end="2024-02-01"))


def test_weekly_trends_after_late_events(spark, tmp_path):
    """Only the days of late events are written again; the trends equal those of all events."""
    known = spark.read.schema(EVENTS_SCHEMA).parquet("/root/testdata/sf0.001/events.parquet")
    late = known.where("event_id % 7 = 0 AND dayofmonth(ts) IN (4, 11, 12)")
    early = known.join(late.select("event_id"), "event_id", "left_anti")
    root = str(tmp_path / "sets")
    build_session_sets(ShopTables.from_events_frame(early), root)
    every = ShopTables.from_events_frame(known)
    update_session_sets(every, root, [r[0] for r in late.select(F.to_date("ts")).distinct().collect()])
    sets = over(read_session_sets(spark, root))
    for name in ("weekly_session_trend", "weekly_sessions_by_device", "weekly_sessions_orders", "weekly_sources", "weekly_source_device_ratio"):
        assert rows(QUERIES[name].on(sets)) == rows(QUERIES[name].on(every)), name


def test_empty_tables(spark, tmp_path):
    build_session_sets(shop(spark), str(tmp_path / "sets"))
    (tmp_path / "sets" / "session_sets_by_day").mkdir(exist_ok=True)
    sets = read_session_sets(spark, str(tmp_path / "sets"))
    assert ops.top_traffic_sources(sets, end="2024-01-20").count() == 0
    assert ops.conversion_rate(sets, sets, end="2024-01-20").first()["total_sessions"] == 0


def test_registered_queries(spark):
    for name, query in SET_QUERIES.items():
        got = query(spark, "/root/testdata/sf0.001")
        assert rows(got) == rows(QUERIES[name.removeprefix("sets_")](spark, "/root/testdata/sf0.001")), name
