"""The threshold algorithm against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionscope.llm import threshold_topk


def brute(rows, k, scale):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in usable]
    queries = {}
    for i, v in ints:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, u in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in ints if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumn("id", F.lit("clash")).withColumn("vector", F.lit(1)).withColumn("cell", F.lit(2))


def test_ties_nulls_repeats_and_blocks(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a hot vector: ties
    rows += [(200, rows[200][1]), (7, rows[7][1])]  # repeated rows
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (800, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (900, [0.0] * 6), (901, []), (902, [2.0, 1.0])]
    df = threshold_topk.top_k_inner_product(
        frame(spark, rows), F.col("vec_id") % 100 == 0, k=10, block_vectors=90, block_queries=3
    )
    assert got(df) == brute(rows, 10, 1024)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0])]
    assert got(threshold_topk.top_k_inner_product(frame(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows, 10, 1024)
    assert got(threshold_topk.top_k_inner_product(frame(spark, []), F.col("vec_id") % 100 == 0)) == []


def test_the_bound_ends_the_walk_early():
    """With a few strong directions most vectors are never scored."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-1000, 1000, (5000, 3))
    lists = threshold_topk.SortedLists(np.arange(5000), vectors)
    query = np.array([900, 10, -5])
    ids, scores = lists.top(query, -1, 10)
    want = sorted((-int(s), i) for i, s in enumerate(vectors @ query))[:10]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
    assert lists.scored < 2500


@pytest.mark.parametrize("big", [10**7, 10**8])
def test_large_components_stay_exact(big):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-big, big, (300, 40))
    ids, scores = threshold_topk.SortedLists(np.arange(300), vectors).top(vectors[0], 0, 5)
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[0], v)), i) for i, v in enumerate(vectors) if i)
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == exact[:5]
