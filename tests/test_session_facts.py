"""Landings, bounces and funnel steps from stored facts against the rows and the twins."""

import duckdb
import pytest

from sessionscope import operators as ops
from sessionscope.plans.inspect import plan_summary
from sessionscope.plans.oracle import oracle_on_shop_tables
from sessionscope.plans.registry import FACT_PAGES, FACT_QUERIES, QUERIES
from sessionscope.rollups import build_session_facts, read_session_facts
from sessionscope.sources.schemas import ORDERS_SCHEMA, PAGEVIEWS_SCHEMA, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables
from tests.helpers import rows, shop
from tests.test_random_oracle import _arrow, _multiset, random_shop_rows

CHAINS = [
    "sessions_with_landing_page", "bounced_sessions", "bounce_markers", "bounce_rate",
    "test_first_pageviews", "test_landing_pages", "test_bounced_sessions", "test_bounce_markers", "bounce_rate_by_landing_page",
    "session_first_pv_and_count", "session_landing_details", "weekly_bounce_trend", "weekly_bounce_trend_counts",
    "session_funnel_flags", "funnel_counts", "funnel_rates",
]
PAID = ("gsearch", "nonbrand", "desktop", None)


def over(spark, shop_tables, root):
    build_session_facts(shop_tables, root, pages=FACT_PAGES, launches=("/lander-1",))
    facts = read_session_facts(spark, root)
    return ShopTables(sessions=facts, pageviews=facts)


@pytest.mark.parametrize("seed,hot_share,repeats", [(41, 0.0, False), (42, 1 / 3, True)])
def test_every_chain(spark, tmp_path, seed, hot_share, repeats):
    tables = random_shop_rows(seed, hot_share=hot_share, repeats=repeats)
    schemas = (SESSIONS_SCHEMA, PAGEVIEWS_SCHEMA, ORDERS_SCHEMA)
    con = duckdb.connect()
    for name, r, s in zip(("website_sessions", "website_pageviews", "shop_orders"), tables, schemas):
        con.register(f"{name}_arrow", _arrow(r, s))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    facts = over(spark, ShopTables(*(spark.createDataFrame(r, s) for r, s in zip(tables, schemas))), str(tmp_path))
    for name in CHAINS:
        df = QUERIES[name].on(facts)
        got, want = df.toArrow(), con.sql(oracle_on_shop_tables(name)).to_arrow_table()
        columns = sorted(want.column_names)
        assert got.num_rows and _multiset(got, columns) == _multiset(want, columns), name


def test_a_chain_reads_no_pageview_and_groups_nothing_by_session(spark, tmp_path):
    t = ShopTables.from_events(spark, "/root/testdata/sf0.001")
    facts = over(spark, t, str(tmp_path))
    for name in CHAINS:
        text = plan_summary(QUERIES[name].on(facts))["text"]
        scans = [x for x in text.splitlines() if x.startswith("Location:")]
        assert scans and all("session_facts" in x for x in scans), name
        assert "Join" not in text, name
    # a window on sessions skips days, and only the columns in use are read
    text = plan_summary(ops.funnel_counts(facts.sessions, facts.pageviews, start="2024-01-05", end="2024-01-25"))["text"]
    assert "PartitionFilters: [isnotnull(created_date" in text
    assert "first:struct" not in text.split("ReadSchema:")[1].splitlines()[0]


def test_sessions_of_several_rows_unknown_ones_and_late_views(spark, tmp_path):
    t = shop(
        spark,
        sessions=[
            (1, "2024-01-05 10:00:00", *PAID), (1, "2024-01-06 10:00:00", *PAID), (1, "2024-01-05 10:00:00", *PAID),
            (2, "2024-01-05 11:00:00", *PAID), (2, "2024-01-05 11:00:00", "bsearch", "brand", "mobile", None),
            (3, "2024-01-05 12:00:00", *PAID),
        ],
        pageviews=[
            (1, "2024-01-05 10:00:00", 1, "/home"), (2, "2024-01-05 11:00:00", 2, "/lander-1"),
            (3, "2024-01-07 10:00:00", 9, "/home"), (4, "2024-05-05 10:00:00", 1, "/cart"),
            (5, "2024-05-05 11:00:00", 2, "/home"),
        ],
    )
    facts = over(spark, t, str(tmp_path))
    for kw in (dict(start="2024-01-05", end="2024-01-07"), dict(start="2024-01-06", end="2024-01-07")):
        for op in (ops.session_funnel_flags, ops.session_landing_details, ops.weekly_bounce_trend):
            assert rows(op(facts.sessions, facts.pageviews, **kw)) == rows(op(t.sessions, t.pageviews, **kw)), op
    for op in (ops.test_first_pageviews, ops.test_landing_pages):
        assert rows(op(facts.sessions, facts.pageviews, end="2024-01-20")) == rows(op(t.sessions, t.pageviews, end="2024-01-20"))
    for end in ("2024-01-07", "2024-01-05", None):
        assert rows(ops.bounced_sessions(facts.pageviews, end=end)) == rows(ops.bounced_sessions(t.pageviews, end=end))


def test_what_the_facts_lack_is_refused(spark, tmp_path):
    t = shop(spark, sessions=[(1, "2024-01-05 10:00:00", *PAID)], pageviews=[(1, "2024-01-05 10:00:00", 1, "/home")])
    build_session_facts(t, str(tmp_path / "a"), pages=("/home",))
    facts = read_session_facts(spark, str(tmp_path / "a"))
    for op in (ops.funnel_counts, ops.bounce_rate_by_landing_page, ops.weekly_bounce_trend):
        with pytest.raises(ValueError, match="hold no"):
            op(facts, facts)
    falling = shop(
        spark,
        sessions=[(1, "2024-01-05 10:00:00", *PAID)],
        pageviews=[(1, "2024-01-06 10:00:00", 1, "/home"), (2, "2024-01-05 10:00:00", 1, "/cart")],
    )
    with pytest.raises(ValueError, match="rise with time"):
        build_session_facts(falling, str(tmp_path / "b"))


def test_empty_tables(spark, tmp_path):
    facts = over(spark, shop(spark), str(tmp_path))
    assert ops.bounce_rate(facts.pageviews, end="2024-01-20").first()["sessions"] == 0
    assert ops.funnel_counts(facts.sessions, facts.pageviews).first()["sessions"] == 0


def test_registered_queries(spark):
    for name, query in FACT_QUERIES.items():
        assert rows(query(spark, "/root/testdata/sf0.001")) == rows(QUERIES[name.removeprefix("facts_")](spark, "/root/testdata/sf0.001"))
