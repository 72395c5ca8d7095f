"""Days that tables are pruned by: set by the writer, lost where a column is computed anew."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionscope import operators as ops
from sessionscope.functions.timebuckets import of_session_days, within
from sessionscope.plans.oracle import ORACLE_SQL
from sessionscope.plans.registry import QUERIES
from sessionscope.sources import marks
from sessionscope.sources.schemas import EVENTS_SCHEMA
from sessionscope.sources.tables import ShopTables, layout_tokens
from sessionscope.streaming import append_events, start_shop_ingest
from tests.conftest import DATA_SMALL
from tests.helpers import rows, shop
from tests.test_random_oracle import _multiset, random_shop_rows
from tests.test_streaming import _events, ingest, same

PAID = ("gsearch", "nonbrand", "desktop", None)
JANUARY = dict(start="2024-01-01", end="2024-02-01")


def days(pageviews):
    return {r.website_pageview_id: r.session_date and str(r.session_date) for r in pageviews.collect()}


@pytest.fixture
def odd(spark):
    """A session with a view on another day, one whose rows name two days, a view without a session."""
    return shop(
        spark,
        sessions=[
            (1, "2024-01-05 23:00:00", *PAID),
            (2, "2024-01-06 10:00:00", *PAID), (2, "2024-01-20 10:00:00", *PAID),
            (3, "2024-01-07 10:00:00", *PAID),
        ],
        pageviews=[
            (1, "2024-01-05 23:00:00", 1, "/home"), (2, "2024-01-06 00:10:00", 1, "/cart"),
            (3, "2024-01-06 10:00:00", 2, "/home"), (4, "2024-01-20 10:00:00", 9, "/home"),
        ],
        orders=[(7, "2024-01-06 00:20:00", 1)],
    )


def test_session_days_of_odd_rows(spark, tmp_path, odd):
    odd.write(str(tmp_path / "shop"))
    stored = ShopTables.from_directory(spark, str(tmp_path / "shop"))
    assert days(stored.pageviews) == {1: "2024-01-05", 2: "2024-01-05", 3: None, 4: None}
    for kw in (dict(start="2024-01-05", end="2024-01-06"), dict(start="2024-01-19", end="2024-01-21"), JANUARY, {}):
        for op in (ops.session_funnel_flags, ops.funnel_pageview_flags, ops.session_landing_details):
            window = {"start": None, "end": None, **kw}
            assert rows(op(stored.sessions, stored.pageviews, **window)) == rows(op(odd.sessions, odd.pageviews, **window))


@pytest.mark.parametrize("seed,hot_share,repeats", [(22, 1 / 3, True)])
def test_all_queries_over_the_stored_layouts(spark, tmp_path, seed, hot_share, repeats):
    """Random tables, stored by days and in the catalog, against the tables themselves."""
    from sessionscope.sources.schemas import ORDERS_SCHEMA, PAGEVIEWS_SCHEMA, SESSIONS_SCHEMA

    schemas = (SESSIONS_SCHEMA, PAGEVIEWS_SCHEMA, ORDERS_SCHEMA)
    tables = random_shop_rows(seed, n_sessions=200, hot_share=hot_share, repeats=repeats)
    plain = ShopTables(*(spark.createDataFrame(r, s) for r, s in zip(tables, schemas)))
    plain.write(str(tmp_path / "shop"))
    stored = ShopTables.from_directory(spark, str(tmp_path / "shop"))
    differing = [n for n, q in QUERIES.items() if rows(q.on(stored)) != rows(q.on(plain))]
    assert not differing


def test_an_unrelated_created_date_is_no_day(spark, tmp_path):
    """The same folders without the layout file: nothing is known, nothing is pruned."""
    t = shop(spark, sessions=[(1, "2024-01-05 10:00:00", *PAID)])
    for name, df in t.named().items():
        df.withColumn("created_date", F.lit("2031-01-01").cast("date")).write.partitionBy("created_date").parquet(str(tmp_path / name))
    t.pageviews.withColumn("created_date", F.lit("2031-01-01").cast("date")).coalesce(1).write.mode("append").parquet(str(tmp_path / "website_pageviews" / "created_date=2031-01-01"))
    t.orders.coalesce(1).write.mode("append").parquet(str(tmp_path / "shop_orders" / "created_date=2031-01-01"))
    read = ShopTables.from_directory(spark, str(tmp_path))
    assert layout_tokens(spark, str(tmp_path)) == []
    assert within(read.sessions, **JANUARY).count() == 1


def test_a_changed_time_is_not_pruned_by_its_old_day(spark, tmp_path):
    t = shop(
        spark,
        sessions=[(1, "2024-01-31 23:00:00", *PAID)],
        pageviews=[(1, "2024-01-31 23:00:00", 1, "/home")],
    )
    t.write(str(tmp_path / "shop"))
    stored = ShopTables.from_directory(spark, str(tmp_path / "shop"))
    moved = stored.sessions.withColumn("created_at", F.expr("created_at + INTERVAL 3 HOURS"))
    february = dict(start="2024-02-01", end="2024-03-01")
    assert marks.day_partitioned(stored.sessions) and not marks.day_partitioned(moved)
    assert within(moved, **february).count() == 1 and within(stored.sessions, **february).count() == 0
    assert of_session_days(stored.pageviews, moved, **february) is None
    kw = dict(start="2024-01-31 23:30:00", end="2024-03-01")
    assert ops.session_first_pv_and_count(moved, stored.pageviews, **kw).first()["count_pageviews"] == 1


def test_pageviews_of_another_layout_are_not_pruned(spark, tmp_path, odd):
    for name in ("a", "b"):
        odd.write(str(tmp_path / name))
    a, b = (ShopTables.from_directory(spark, str(tmp_path / n)) for n in ("a", "b"))
    assert of_session_days(a.pageviews, a.sessions, **JANUARY) is not None
    assert of_session_days(a.pageviews, b.sessions, **JANUARY) is None
    assert of_session_days(a.pageviews, marks.unmarked(a.sessions), **JANUARY) is None


def test_appended_rows_keep_their_own_days_only(spark, tmp_path):
    """A session of two writes has pageviews under two days: no pruning by the session's."""
    root = str(tmp_path / "shop")
    first = shop(spark, sessions=[(1, "2024-01-05 10:00:00", *PAID)], pageviews=[(1, "2024-01-05 10:00:00", 1, "/home")])
    second = shop(spark, sessions=[(1, "2024-01-20 10:00:00", *PAID)], pageviews=[(2, "2024-01-20 10:00:00", 1, "/cart")])
    first.write(root)
    second.write(root, mode="append")
    both = ShopTables.from_directory(spark, root)
    assert len(layout_tokens(spark, root)) == 2 and marks.day_partitioned(both.pageviews)
    got = ops.session_first_pv_and_count(both.sessions, both.pageviews, start="2024-01-05", end="2024-01-06").collect()
    assert [r.count_pageviews for r in got] == [2]
    first.write(root, mode="overwrite")
    assert len(layout_tokens(spark, root)) == 1
    first.save_as_tables("appended_shop", buckets=2, mode="overwrite")
    assert of_session_days(*(getattr(ShopTables.from_tables(spark, "appended_shop"), n) for n in ("pageviews", "sessions")), **JANUARY) is not None
    second.save_as_tables("appended_shop", buckets=2, mode="append")
    both = ShopTables.from_tables(spark, "appended_shop")
    assert of_session_days(both.pageviews, both.sessions, **JANUARY) is None
    got = ops.session_first_pv_and_count(both.sessions, both.pageviews, start="2024-01-05", end="2024-01-06").collect()
    assert [r.count_pageviews for r in got] == [2]


def test_a_stream_has_a_target_of_its_own(spark, tmp_path):
    """A new checkpoint starts at batch 0 again; it may not overwrite the first query's folders."""
    landing, root = tmp_path / "landing", tmp_path / "shop"
    spark.createDataFrame(_events((1, "2024-01-05 10:00:00", 1, "view")), EVENTS_SCHEMA).coalesce(1).write.parquet(str(landing))
    ingest(spark, landing, root)
    spark.createDataFrame(_events((2, "2024-01-05 11:00:00", 2, "view")), EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
    other = start_shop_ingest(spark, str(landing), str(root), checkpoint=str(tmp_path / "other"), trigger={"availableNow": True})
    with pytest.raises(Exception, match="target of its own"):
        other.query.awaitTermination(300)
    streamed = ingest(spark, landing, root)  # the first query resumes
    assert streamed.sessions.count() == streamed.pageviews.count() == 2
    assert of_session_days(streamed.pageviews, streamed.sessions, **JANUARY) is not None
    written = str(tmp_path / "written")
    ShopTables.from_events(spark, DATA_SMALL).write(written)
    with pytest.raises(ValueError, match="target of its own"):
        append_events(spark.createDataFrame(_events((1, "2024-01-05 10:00:00", 1, "view")), EVENTS_SCHEMA), 0, written)


def test_events_without_a_user_belong_to_no_session(spark, tmp_path):
    """Against the twins, and alike derived, stored and streamed."""
    t = dt.datetime
    known = spark.read.parquet(f"{DATA_SMALL}/events.parquet")
    lost = spark.createDataFrame(
        [(10_000 + i, t(2024, 1, 4 + i % 20, 11 * (i % 2), 0), None, ("view", "click", "purchase", "error")[i % 4], 1.0, '{"k": 60}') for i in range(60)],
        EVENTS_SCHEMA,
    )
    path = str(tmp_path / "data" / "events.parquet")
    known.unionByName(lost).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    derived = ShopTables.from_events(spark, str(tmp_path / "data"))
    assert derived.sessions.count() == 397 and derived.pageviews.count() == 1060
    derived.write(str(tmp_path / "shop"))
    stored = ShopTables.from_directory(spark, str(tmp_path / "shop"))
    append_events(spark.read.schema(EVENTS_SCHEMA).parquet(path), 0, str(tmp_path / "streamed"))
    same(ShopTables.from_directory(spark, str(tmp_path / "streamed")), derived)
    for name, query in QUERIES.items():
        want = con.sql(ORACLE_SQL[name]).to_arrow_table()
        got = query(spark, str(tmp_path / "data")).toArrow()
        columns = sorted(got.column_names)
        assert _multiset(got, columns) == _multiset(want, columns), name
        assert _multiset(query.on(stored).toArrow(), columns) == _multiset(want, columns), name


def test_a_bound_that_is_no_time_is_refused(spark):
    t = shop(spark, sessions=[(1, "2024-01-05 10:00:00", *PAID)])
    with pytest.raises(ValueError, match="not a time"):
        within(t.sessions, end="2024-01-01' OR '1'='1")
