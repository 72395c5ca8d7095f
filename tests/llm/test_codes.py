"""Vector codes against assignments that evaluate every entry."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionscope.llm import pivot_codes as pc


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(entries, x):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(entries))


def brute(rows, parts, size, rounds, scale=1024):
    """[(vec_id, label, code, error)], digest."""
    kept = [(i, l, [math.floor(scale * x) for x in v]) for i, v, l in rows if usable(v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    cut = lambda v: [(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)]
    first = {}
    for i, _, v in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[cut(first[i])[p] for i in sorted(first)[:size]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for *_, v in kept:
                own[nearest(books[p], cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])]
    out = []
    for i, l, v in kept:
        found = [nearest(books[p], cut(v)[p]) for p in range(parts)]
        out.append((i, l, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


def some_rows(width, seed=7):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(width)], r.choice([1, 2, 2, 2, None])) for i in range(260)]
    rows += [(1000 + i, [0.125] * width, 3) for i in range(90)]  # a hot vector, equally far from equal entries
    rows += [(1, rows[1][1], 1), (2, rows[9][1], None), (5, rows[5][1], 2), (None, rows[6][1], 2)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * (width - 2), 1), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, 2)]
    return rows + [(904, [], 5), (905, [0.5, -0.25], 5)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumn("vector", F.lit("clash")).withColumn("to_pivots", F.lit(1)).withColumn("_label", F.lit(2))


@pytest.mark.parametrize("width,parts,size,pivots", [(12, 4, 24, 5), (10, 4, 16, 1), (6, 3, 256, 40), (3, 4, 8, 2)])
def test_equals_brute_force(spark, width, parts, size, pivots):
    rows = some_rows(width)
    codes, books = pc.compress_vectors(frame(spark, rows).repartition(4), parts=parts, size=size, rounds=3, pivots=pivots)
    want, digest = brute(rows, parts, size, 3)
    assert order(tuple(r) for r in codes.collect()) == order(want)
    assert books.sha256() == digest
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    got = pc.with_label_errors(codes).collect()
    assert order((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got) == order((*w, totals[w[1]]) for w in want)


def test_ties_go_to_the_lower_index(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 0.0], 1)]
    codes, _ = pc.compress_vectors(frame(spark, rows), parts=1, size=3, rounds=0)
    assert {r.vec_id: r.code for r in codes.collect()} == {0: "00", 1: "00", 2: "02", 3: "00"}


def test_pivots_spare_evaluations_and_lose_none():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (256, 8))
    parts = centres[rng.integers(0, 256, 5000)] + rng.integers(-30, 30, (5000, 8))
    pivots = pc.choose_pivots(centres, 8)
    assigner = pc.Assigner(centres, pivots)
    index, square = assigner.nearest(parts, pc._distances(parts, pivots))
    every = ((parts[:, None] - centres) ** 2).sum(2)
    assert (square == every.min(1)).all() and (index == every.argmin(1)).all()
    assert assigner.evaluated < 0.2 * every.size


def test_empty_tables_and_vectors(spark):
    for rows in ([], [(1, None, 1)]):
        codes, books = pc.compress_vectors(frame(spark, rows))
        assert codes.count() == 0 and pc.with_label_errors(codes).count() == 0 and books.entries.size == 0
    codes, _ = pc.compress_vectors(frame(spark, [(1, [], 1)]))
    assert [tuple(r) for r in codes.collect()] == [(1, 1, "00000000", 0)]
    codes, _ = pc.compress_vectors(frame(spark, [(None, [1.0] * 4, 1), (None, [0.5] * 4, None)]))
    # the smaller vector is the entry until the mean of both, 768, replaces it
    assert order(tuple(r) for r in codes.collect()) == order([(None, 1, "00000000", 4 * 256**2), (None, None, "00000000", 4 * 256**2)])


def test_a_component_without_exact_squares_is_an_error(spark):
    with pytest.raises(Exception, match="exact"):
        pc.compress_vectors(frame(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)]))[0].count()
