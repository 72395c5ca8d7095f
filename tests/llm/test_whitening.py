"""Whitening against numpy's eigenvectors of the whole covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionscope.llm import chebyshev_whitening as cw


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, count, scale=64, shift=1_000_000):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of the kept rows, in order."""
    kept = [(i, [math.floor(scale * x) + shift for x in v]) for i, v in rows if usable(v)]
    width = max(len(v) for _, v in kept)
    kept = [(i, v + [shift] * (width - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda v: np.array([float(Fraction(n * x - s, n)) for x, s in zip(v, sums)])
    x = np.array([centred(v) for v in fit])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = sum(1 for e in values[:count] if e > 1e-12 * values[0])
    out = []
    for i, v in kept:
        w = np.abs(centred(v) @ vectors[:, :count]) / np.sqrt(values[:count])
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        out += [(i, c + 1, n, dev, w[c], values[c] / values.sum()) for c in range(count)]
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumn("_x", F.lit("clash")).withColumn("j", F.lit(1)).withColumn("n", F.lit(2))


def whitened(spark, rows, count):
    df = frame(spark, rows).repartition(5)
    model = cw.fit_whitening(df, components=count)
    return model, cw.whiten(df, model).collect()


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4] for r in got], [r[4] for r in want], atol=1e-9)
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)


def some_rows(width=60, many=300, seed=5):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1 + (k % 7) / 3) for k in range(width)]) for i in range(many)]
    rows += [(1000 + i, [0.5] * width) for i in range(150)]  # a hot vector counts once
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, [0.25] * width)]
    rows += [(901, None), (902, [1.0, None] + [0.0] * (width - 2)), (903, [float("nan")] * width), (904, [float("-inf")] * width)]
    return rows + [(905, []), (906, [2.0, 1.0])]


def test_equals_numpy(spark):
    rows = some_rows()
    model, got = whitened(spark, rows, 8)
    check(got, brute(rows, 8))
    assert len(model.eigenvalues) == 8 and model.identity_error < 1e-10
    assert model.passes > 8  # the block is narrower than the space: the polynomial ran
    signs = {(r.component, np.sign(r.whitened)) for r in got if r.vec_id == 5}
    assert len(signs) == 8
    a, b = ([r.whitened for r in got if r.vec_id == 3 and r.component == c] for c in (1, 2))
    assert len(a) == len(b) == 2 and a[0] == pytest.approx(a[1])


def test_few_dimensions_and_few_vectors(spark):
    rows = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(6)]
    check(whitened(spark, rows, 16)[1], brute(rows, 16))  # the third direction has no variance
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        model, got = whitened(spark, rows, 16)
        assert got == [] and len(model.eigenvalues) == 0


def test_a_flat_spectrum_is_certified():
    """Eigenvalues a thousandth apart, and a spectrum over six orders."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (1 + np.linspace(0, 0.2, 200)[::-1], np.logspace(0, -6, 200)):
        v = turn * values @ turn.T
        found, vectors, residual = cw.leading_eigenpairs(lambda q: v @ q, 200, 16)
        np.testing.assert_allclose(found, values[:16], rtol=1e-12)
        assert np.abs(np.abs(np.sum(vectors * turn[:, :16], axis=0)) - 1).max() < 1e-12
        assert residual < 1e-12


def test_the_polynomial_damps_the_unwanted_end():
    values = np.array([4.0, 3.0, 2.0, 0.9, 0.5, 0.1, 0.0])
    q = np.eye(7)
    out = np.diag(cw._filtered(lambda y: values[:, None] * y, q, values[:, None] * q, 4.0, 0.0, 1.0, 8))
    assert out[0] == pytest.approx(1) and np.abs(out[3:]).max() < 1e-8 < np.abs(out[2])


def test_the_low_end_is_bounded():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((100, 100)))[0]
    for values in (np.linspace(50, 60, 100), np.append(np.linspace(50, 60, 99), 150), np.logspace(-8, 0, 100)):
        v = turn * values @ turn.T
        low = cw._LowEnd(100, 1)
        for _ in range(8):
            low.step(v @ low.vector)
        assert (0.8 * values.min() if values.min() > 1 else 0) <= low.bound() <= values.min()


def test_uncertified_is_an_error(spark):
    v = np.diag(1 + np.linspace(0, 1e-9, 300)[::-1])
    with pytest.raises(ArithmeticError):
        cw.leading_eigenpairs(lambda q: v @ q + 1e-4 * np.random.default_rng(int(abs(q[0, 0]) * 1e9)).standard_normal(q.shape), 300, 4, max_rounds=3)


def test_a_deviation_beyond_64_bits_is_an_error(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5.0, 2.0])]
    with pytest.raises(Exception, match="64 bits"):
        whitened(spark, rows, 2)
