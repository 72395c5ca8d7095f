"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Components become whole numbers, and each distinct vector counts once in the
fit.  The covariance V is never formed: one pass over the fit list, spread over
all tasks, returns V Q = Xᵀ(X Q)/n for a narrow block Q, with X centred before it
is multiplied.  A round

* damps the unwanted end of the spectrum, up to the smallest Ritz value of the
  block, by a Chebyshev polynomial of V applied to Q (three-term recurrence, one
  pass for each degree); its lower end is 0 in the first round, whose passes carry
  one column more, a Lanczos walk that bounds the smallest eigenvalue for the others,
* makes the block orthonormal again (QR), and
* rotates it to Ritz vectors (Rayleigh-Ritz, one pass, whose product also starts
  the next recurrence).

The rounds end when the residual |V u - e u| of every wanted component is at the
rounding level of double precision, or stops falling within a stated distance of
it; anything else is an error, never an uncertified result.  What the driver
holds is a few matrices of dimensions x block width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import cut, matrix
from sessionscope.llm.threshold_topk import usable

_CELLS = 1 << 21  # numbers of a block of rows that are centred at a time
_ROUNDING = 4e-15  # residuals below this times the root of the dimensions are rounding
_CLOSE = 1e-10  # a residual that no longer falls must be below this
_FLAT = 1e-12  # directions with a smaller share of the largest variance have none


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with sums ``sums``; unit eigenvectors in the columns of
    ``components``, by falling eigenvalue."""

    scale: int
    shift: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def width(self) -> int:
        return len(self.sums)


def whole_numbers(vector_col: str, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every entry, c as double."""
    return F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int, fill: int) -> Iterator[tuple]:
    """(rows of the batch, their vectors) in blocks of bounded size."""
    step = max(1, _CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, matrix(part.column(column), width, fill)


def _mean(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole part and rest: numbers minus both keep every bit of the difference."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def _sums(fit: DataFrame, width: int, fill: int) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for _, x in _blocks(batches, 0, width, fill):
            n += len(x)
            total += x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, width), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["j", "s"]
            )

    found = dict(fit.mapInArrow(run, "j int, s long").groupBy("j").agg(F.sum("s")).collect())
    return found.get(-1, 0), tuple(found.get(j, 0) for j in range(width))


def _total(fit: DataFrame, n: int, sums: tuple[int, ...], fill: int, of: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``of(centred rows)`` over the fit list, a matrix of ``shape``: each
    task adds up its own rows, Spark adds up the tasks."""
    width, size = len(sums), shape[0] * shape[1]
    whole, rest = _mean(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(shape), False
        for _, x in _blocks(batches, 0, width, fill):
            total += of((x - whole) - rest)
            met = True
        if met:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(total.ravel())], names=["place", "value"]
            )

    out = np.zeros(size)
    for place, value in fit.mapInArrow(run, "place int, value double").groupBy("place").sum("value").collect():
        out[place] = value
    return out.reshape(shape)


class _LowEnd:
    """Lanczos steps on one vector; ``bound`` lies below the spectrum seen so far by the
    size of what the steps have left over."""

    def __init__(self, width: int, seed: int):
        v = np.random.default_rng(seed).standard_normal(width)
        self._basis, self._diagonal, self._beside = [v / np.linalg.norm(v)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self._basis[-1]

    def step(self, product: np.ndarray) -> None:
        self._diagonal.append(float(self.vector @ product))
        known = np.array(self._basis).T
        for _ in range(2):  # orthogonal to working precision
            product = product - known @ (known.T @ product)
        left = float(np.linalg.norm(product))
        self._beside.append(left)
        self._basis.append(product / left if left > 0 else product)

    def bound(self) -> float:
        if not self._diagonal:
            return 0.0
        inner = self._beside[:-1]
        t = np.diag(self._diagonal) + np.diag(inner, 1) + np.diag(inner, -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self._beside[-1])


def _filtered(
    times: Callable, q: np.ndarray, vq: np.ndarray, top: float, low: float, high: float, degree: int
) -> np.ndarray:
    """p(V) Q for the Chebyshev polynomial that stays small on [low, high], scaled to 1 at
    ``top``; V Q is known, so ``degree - 1`` passes."""
    middle, half = (low + high) / 2, (high - low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (2 * following / half) * (times(now) - middle * now) - sigma * following * before
        sigma = following
    return now


def leading_eigenpairs(
    times: Callable[[np.ndarray], np.ndarray],
    width: int,
    count: int,
    *,
    block: int | None = None,
    degree: int = 8,
    max_rounds: int = 40,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors in columns, largest residual) of the ``count``
    largest eigenvalues of the symmetric, non-negative operator ``times``."""
    count = min(count, width)
    block = min(width, block or max(3 * count, count + 32))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))[0]
    vq = times(q)
    best, low_end = np.inf, _LowEnd(width, seed + 1)

    def times_and_low_end(y: np.ndarray) -> np.ndarray:
        product = times(np.column_stack([y, low_end.vector]))
        low_end.step(product[:, -1])
        return product[:, :-1]

    for turned in range(max_rounds):
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if top <= 0:
            return values[:count], q[:, :count], 0.0
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:count].max())
        if residual <= _ROUNDING * np.sqrt(width) * top or (residual > best / 2 and residual <= _CLOSE * top):
            return values[:count], q[:, :count], residual
        best = min(best, residual)
        if block < width:
            high = max(values[-1], 1e-9 * top)
            low = min(low_end.bound(), 0.99 * high)
            q = _filtered(times if turned else times_and_low_end, q, vq, top, low, high, degree)
        else:
            q = vq
        q = np.linalg.qr(q)[0]
        vq = times(q)
    raise ArithmeticError(f"the eigenvectors are not certified after {max_rounds} rounds: residual {residual:.3g} of {top:.3g}")


def _rows(vectors: DataFrame, vector_col: str, scale: int, shift: int) -> DataFrame:
    return vectors.where(usable(vector_col)).withColumn("_x", whole_numbers(vector_col, scale, shift))


def fit_whitening(
    vectors: DataFrame,
    *,
    vector_col: str = "embedding",
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    degree: int = 8,
) -> Whitening:
    """Mean and leading eigenvectors of the covariance of the distinct vectors.

    Entries are floor(``scale`` * c) + ``shift``.  Every distinct vector counts once
    and all of them count.  Repeated rows meet in a grouping with a map-side step,
    so a hot vector reaches its task once from each map task.

    Defined cases: vectors that are null or hold a null or non-finite entry take no
    part; a vector shorter than the longest lacks nothing but zeros; without vectors
    ``n`` is 0 and there are no components; directions without variance (below 1e-12
    of the largest) are no components, so equal vectors have none.
    """
    fit = cut(_rows(vectors, vector_col, scale, shift).select("_x").distinct(), "fit-list")
    width = fit.agg(F.max(F.size("_x"))).first()[0] or 0
    n, sums = _sums(fit, width, shift) if width else (0, ())
    none = Whitening(scale, shift, n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    if not n or not width:
        return none
    passes = 0

    def total(of: Callable, shape: tuple[int, int]) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _total(fit, n, sums, shift, of, shape) / n

    def times(q: np.ndarray) -> np.ndarray:
        return total(lambda x: x.T @ (x @ q), q.shape)

    trace = float(total(lambda x: (x * x).sum(axis=0)[None, :], (1, width)).sum())
    values, found, residual = leading_eigenpairs(times, width, components, degree=degree)
    kept = values > max(0.0, _FLAT * values[0])
    values, found = values[kept], found[:, kept]
    if not len(values):
        return none
    # the largest entry of a component is positive
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    projection = found / np.sqrt(values)

    def squares(x: np.ndarray) -> np.ndarray:
        w = x @ projection
        return w.T @ w

    identity = total(squares, (len(values), len(values)))
    error = float(np.abs(identity - np.eye(len(values))).max())
    return Whitening(scale, shift, n, sums, found, values, trace, error, residual, passes)


def whiten(vectors: DataFrame, model: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row for each usable row and component: its centred vector projected on the
    component over the root of the eigenvalue.  ``deviation`` is the exact sum of
    (n * x - sum)² over the dimensions; one that needs more than 64 bits is an error.

    Defined cases: rows with an unusable vector have no result, rows with a null id
    keep the null, repeated rows come out each; entries beyond the fitted width are
    not read; without components there are no rows; other columns are not read.
    """
    n, width, fill = model.n, model.width, model.shift
    count = len(model.eigenvalues)
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = _rows(vectors, vector_col, model.scale, fill).select(
        F.col(id_col).cast("long").alias("vec_id"), F.slice("_x", 1, max(1, width)).alias("_x")
    )
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    whole, rest = _mean(n, model.sums)
    left = np.array([s - n * w for s, w in zip(model.sums, whole.tolist(), strict=True)], np.int64)
    projection = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    error = model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, max(width, count), fill):
            x = x[:, :width] - whole
            centred = x - rest
            if float(n) * np.abs(centred).max(initial=0) * np.sqrt(width) > 3.0e9:
                raise OverflowError("a deviation needs more than 64 bits")
            apart = n * x - left
            each = len(x)
            columns = [
                pa.array(np.repeat((apart * apart).sum(axis=1), count)),
                pa.array((centred @ projection).ravel()),
                pa.array(np.tile(explained, each)),
                pa.array(np.full(each * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(each), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), each)),
                    pa.array(np.full(each * count, n, np.int64)),
                    *columns,
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
