"""Brute-force check on random shop tables.

Random sessions, pageviews and orders (NULL traffic attributes, sessions
without pageviews, several orders per session, timestamps exactly at the
window bounds, pageviews past cohort cutoffs, both billing pages in one
session).  Every registered operator runs on them in Spark, and the same
oracle SQL bodies run in DuckDB over the same rows.
"""

import datetime as dt
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sessionscope.plans.oracle import oracle_on_shop_tables
from sessionscope.plans.registry import QUERIES
from sessionscope.sources.schemas import ORDERS_SCHEMA, PAGEVIEWS_SCHEMA, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables

TRAFFIC = [
    ("gsearch", "nonbrand", "https://www.gsearch.com"),
    ("bsearch", "nonbrand", "https://www.bsearch.com"),
    ("gsearch", "brand", "https://www.gsearch.com"),
    (None, None, "https://www.gsearch.com"),
    (None, None, "https://www.bsearch.com"),
    (None, None, None),
    ("socialbook", "pilot", "https://www.socialbook.com"),
    ("gsearch", None, None),
]
URLS = [
    "/home", "/lander-1", "/products", "/the-original-mr-fuzzy", "/cart",
    "/shipping", "/billing", "/billing-2", "/thank-you-for-your-order",
]
# window bounds used by the registry: rows exactly at these instants test < / <= / >
BOUNDS = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 5, 20, 22, 25, 28, 29, 31)]


def random_shop_rows(seed: int, n_sessions: int = 400, hot_share: float = 0.0, repeats: bool = False):
    """``hot_share`` > 0 gives one session that share of all pageviews and orders."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2023, 12, 30)
    sessions, raw_pvs, orders = [], [], []
    for i in range(n_sessions):
        if rng.random() < 0.12:
            t = BOUNDS[rng.integers(len(BOUNDS))]
        else:
            t = start + dt.timedelta(seconds=int(rng.integers(0, 34 * 86400)))
        src, camp, ref = TRAFFIC[rng.integers(len(TRAFFIC))]
        device = "mobile" if rng.random() < 0.35 else "desktop"
        sid = 10_000 + 7 * i
        sessions.append((sid, t, src, camp, device, ref))
        for _ in range(int(rng.choice([0, 1, 1, 1, 2, 3, 5, 8]))):
            lag = dt.timedelta(minutes=int(rng.integers(0, 36 * 60)))
            raw_pvs.append((t + lag, sid, URLS[rng.integers(len(URLS))]))
        for _ in range(int(rng.choice([0, 0, 0, 1, 2]))):
            orders.append((t + dt.timedelta(minutes=int(rng.integers(0, 90))), sid))
    if hot_share > 0:
        hot_sid, hot_t = sessions[0][0], sessions[0][1]
        n_hot = int(len(raw_pvs) * hot_share / (1 - hot_share))
        for _ in range(n_hot):
            lag = dt.timedelta(minutes=int(rng.integers(0, 36 * 60)))
            raw_pvs.append((hot_t + lag, hot_sid, URLS[rng.integers(len(URLS))]))
        for _ in range(int(len(orders) * hot_share / (1 - hot_share))):
            orders.append((hot_t + dt.timedelta(minutes=int(rng.integers(0, 90))), hot_sid))
    raw_pvs.sort(key=lambda r: r[0])  # pageview ids rise with time
    pageviews = [(1 + k, t, sid, url) for k, (t, sid, url) in enumerate(raw_pvs)]
    orders = [(500_000 + k, t, sid, 10.0) for k, (t, sid) in enumerate(orders)]
    if repeats:
        # rows that were loaded twice
        for table, share in ((sessions, 0.1), (orders, 0.2)):
            table.extend([table[i] for i in rng.integers(0, len(table), int(len(table) * share))])
        twice = [pageviews[i] for i in rng.integers(0, len(pageviews), len(pageviews) // 10)]
        pageviews.extend(twice)
    return sessions, pageviews, orders


def _arrow(rows, schema):
    names = [f.name for f in schema.fields]
    types = {"bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "double": pa.float64()}
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table(
        {n: pa.array(list(c), type=types[f.dataType.simpleString()]) for n, c, f in zip(names, cols, schema.fields)}
    )


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _multiset(tbl, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in tbl.to_pylist()), key=repr)


@pytest.mark.parametrize(
    "seed,hot_share,repeats", [(1, 0.0, False), (2, 0.0, False), (4, 1 / 3, False), (5, 0.0, True), (6, 1 / 3, True)]
)
def test_all_queries_on_random_tables(spark, seed, hot_share, repeats):
    s_rows, p_rows, o_rows = random_shop_rows(seed, hot_share=hot_share, repeats=repeats)
    shop = ShopTables(
        spark.createDataFrame(s_rows, SESSIONS_SCHEMA),
        spark.createDataFrame(p_rows, PAGEVIEWS_SCHEMA),
        spark.createDataFrame(o_rows, ORDERS_SCHEMA),
    )
    con = duckdb.connect()
    for name, rows, schema in [
        ("website_sessions", s_rows, SESSIONS_SCHEMA),
        ("website_pageviews", p_rows, PAGEVIEWS_SCHEMA),
        ("shop_orders", o_rows, ORDERS_SCHEMA),
    ]:
        con.register(f"{name}_arrow", _arrow(rows, schema))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    failures, empty = [], []
    for name, spec in QUERIES.items():
        got = spec.on(shop).toArrow()
        want = con.sql(oracle_on_shop_tables(name)).to_arrow_table()
        cols = sorted(got.column_names)
        if cols != sorted(want.column_names) or _multiset(got, cols) != _multiset(want, cols):
            failures.append((name, got.num_rows, want.num_rows))
        if got.num_rows == 0:
            empty.append(name)
    assert not failures, failures
    assert not empty, empty  # every query has something to compare
