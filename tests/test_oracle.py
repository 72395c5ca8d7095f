"""Every registered query against its DuckDB twin on the sf0.01 fixture:
same column names, row count, normalised types and row multiset."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from sessionscope.plans.registry import QUERIES
from tests.conftest import DATA_ORACLE

ORACLE = {k: v for k, v in entry_mod.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{os.path.join(DATA_ORACLE, 'events.parquet')}')")
    yield con
    con.close()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _kind(t: str) -> str:
    t = t.lower()
    for kind, prefixes in {
        "int32": ("int32",),
        "int64": ("int64",),
        "float64": ("double",),
        "string": ("string", "large_string"),
        "date": ("date32",),
        "timestamp": ("timestamp",),
    }.items():
        if t.startswith(prefixes):
            return kind
    return t


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) == 39


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA_ORACLE).toArrow()
    want = duck.sql(ORACLE[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert got.num_rows == want.num_rows
    assert got.num_rows > 0
    g_types = {f.name: _kind(str(f.type)) for f in got.schema}
    w_types = {f.name: _kind(str(f.type)) for f in want.schema}
    assert g_types == w_types

    def multiset(tbl):
        return sorted((tuple(_norm(r[c]) for c in cols) for r in tbl.to_pylist()), key=repr)

    assert multiset(got) == multiset(want)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["landing_page", "sessions", "bounced_sessions", "bounce_rate"]
    assert df.count() >= 0
