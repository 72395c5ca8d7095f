"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors and queries are dealt into blocks of bounded size; every pair of a
vector block and a query block is one cell.  A cell sorts its vectors once per
dimension.  For a query it walks the lists of all dimensions in step (from the
top where the query's component is positive, from the bottom where negative),
scores each vector met for the first time, and keeps the k best.  What no list
has shown yet scores at most the sum of the components at the lists' current
places; once that bound is below the k-th score, nothing unseen can enter.
Ties at the bound are walked on, so equal scores fall to the smaller id.

A cell returns at most k rows per query; the best k over the cells are the
answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FINITE = 1.7976931348623157e308


def quantised(embedding: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: str) -> Column:
    """Not null, and every component a finite number."""
    x = F.col(embedding)
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & v.cast("double").between(-_FINITE, _FINITE)
    )
    return x.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows as 64-bit integers; missing trailing components are 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class SortedLists:
    """A block of vectors with one list per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self._ids, self._vectors = ids, vectors
        largest = int(np.abs(vectors).max(initial=0))
        # sums of products below 2**53 are exact in floating point, which multiplies faster
        self._largest = largest
        self._floats = vectors.astype(np.float64)
        self._rising = np.argsort(vectors, axis=0, kind="stable")
        self.scored = 0

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self._largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self._floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return self._vectors[rows] @ query

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows whose id is not ``own``."""
        n = len(self._ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        rising = self._rising
        seen = np.zeros(n, bool)
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, 8
        while depth < n:
            now = min(n, depth + step)
            met = np.zeros(n, bool)
            # the next places of every list: from its top, or its bottom for a negative component
            met[rising[n - now : n - depth, up]] = True
            met[rising[depth:now, down]] = True
            if not len(up) and not len(down):
                met[:] = True  # a query of zeros scores every vector 0
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            self.scored += len(rows)
            ids = np.concatenate([best_ids, self._ids[rows]])
            scores = np.concatenate([best, self._scores(rows, query)])
            other = np.concatenate([np.ones(len(best_ids), bool), self._ids[rows] != own])
            ids, scores = ids[other], scores[other]
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[order], scores[order]
            if seen.all():
                break
            bound = int(self._vectors[rising[n - now, up], up] @ query[up])
            bound += int(self._vectors[rising[now - 1, down], down] @ query[down])
            if len(best) == k and bound < best[-1]:
                break
            depth, step = now, step * 2
        return best_ids, best


def _cell(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(vectors) and len(queries):
            width = max(vectors["vector"].map(len).max(), queries["vector"].map(len).max())
            lists = SortedLists(vectors["id"].to_numpy(np.int64), _matrix(vectors["vector"], width))
            asked = _matrix(queries["vector"], width)
            for own, query in zip(queries["id"], asked, strict=True):
                ids, scores = lists.top(query, own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def top_k_inner_product(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_vectors: int = 8192,
    block_queries: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows but the query's own.

    Components are floor(``scale`` * x).  Scores are exact while they fit 64 bits.

    Defined cases: vectors that are null or hold a null or non-finite component,
    and rows with a null id, take no part; of vectors of different lengths the
    shorter lacks nothing but zeros; ties go to the smaller id; a repeated row is
    a candidate each time, and a repeated query id asks once, with the smallest
    of its vectors; fewer candidates than ``k`` are all returned; an empty table
    gives no rows; other columns are not read.
    """
    numbers = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    rows = numbers.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("vector"))
    asked = (
        numbers.where(is_query)
        .select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("vector"))
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
    )
    n_vectors, n_queries = _blocks(rows, block_vectors), _blocks(asked, block_queries)
    cell = F.col("v") * n_queries + F.col("q")
    sides = [
        rows.withColumn("v", F.pmod(F.xxhash64("id", "vector"), F.lit(n_vectors))).withColumn(
            "q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
        ),
        asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_queries))).withColumn(
            "v", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1)))
        ),
    ]
    left, right = (s.select(cell.cast("long").alias("cell"), "id", "vector").groupBy("cell") for s in sides)
    found = left.cogroup(right).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
