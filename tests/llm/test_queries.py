"""The registered queries: SQL twins, plans without Python where native, the pipeline's effects."""

import os

import duckdb
import pytest

import corpus_pipeline
from sessionscope.llm.oracle import ORACLE_SQL
from sessionscope.llm.queries import QUERIES
from sessionscope.plans.inspect import plan_summary
from tests.conftest import DATA_SMALL
from tests.llm.test_dedup import near_brute

TABLES = ("documents", "embeddings", "pages", "conversations", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(DATA_SMALL, t)}.parquet')")
    yield con
    con.close()


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA_SMALL).toArrow()
    want = duck.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted((tuple(r[c] for c in columns) for r in t.to_pylist()), key=repr)
    assert got.num_rows > 0
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_exact_dedup", "op9_chat_formatting"])
def test_native_queries_run_no_python(spark, name):
    assert not plan_summary(QUERIES[name](spark, DATA_SMALL))["python"]


def test_pipeline_stages(spark):
    """Each stage against its rule, on what its predecessor kept."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pack"]
    docs = spark.read.parquet(f"{DATA_SMALL}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, kept[-1], DATA_SMALL), name)
        assert out.columns == columns
        kept.append(out)
    read = [[(r.doc_id, r.text) for r in d.collect()] for d in kept]
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA_SMALL}/labels.parquet").collect()}
    stayed = {i for i, _ in read[1]}
    assert sum(i in stayed for i, q in known.items() if q == 1) >= 0.95 * sum(known.values())
    assert len(stayed) < len(read[0])
    last = {}
    for i, t in read[1]:
        last[t] = max(i, last.get(t, i))
    assert sorted(read[2]) == sorted((i, t) for t, i in last.items())
    assert sorted(i for i, _ in read[3]) == sorted({c for _, c, *_ in near_brute(read[2])})
    packed = corpus_pipeline.run(spark, DATA_SMALL).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in read[3]}
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // corpus_pipeline.CAPACITY) + 1
