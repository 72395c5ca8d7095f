"""Vector codes: part-wise codebooks whose nearest entries are found with LAESA pivots.

Vectors are cut into consecutive parts.  Each part has a codebook, refined by
rounds of "assign every part to its nearest entry, replace each entry by the
floored mean of its parts".  All numbers are whole, so every result is exact.

Pivots are fixed points, chosen far apart among the first entries.  The distance
of every part to every pivot is computed once and written beside it.  Entries
move each round, so a round needs the distances of pivots and entries only; for a
part x, an entry c and a pivot p, |d(x, p) - d(p, c)| is a lower bound of d(x, c).
The largest bound over the pivots orders the entries; they are evaluated exactly in
that order until the bound passes the best distance found.  Ties go to the lower
index, so entries whose bound equals the best are still evaluated.

The driver holds codebooks only (parts x entries x width numbers).  A round sends one
row for each used entry from every task to a grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import cut, matrix, unused
from sessionscope.llm.threshold_topk import quantised, usable

_ROWS = 1024  # rows of one part whose bounds are held at a time
_FIRST = 16  # entries evaluated before the bound is asked again
_LIMIT = 1 << 28  # whole numbers up to here have exact squared distances in 64 bits


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]``: whole numbers; ``pivots[part, pivot]`` stay fixed."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        """Of all components, by part, entry and place, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``, from exact squares."""
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        apart = a - b[j]
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64))
    return out


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the entries, each the farthest from those before it."""
    chosen = [0]
    nearest = _distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(entries, entries[chosen[-1:]])[:, 0])
    # equal entries leave fewer: the first one fills up
    return entries[chosen + [0] * (count - len(chosen))]


class Assigner:
    """Nearest entries of the parts at one place."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self._entries = entries
        self._apart = _distances(pivots, entries)  # pivot x entry
        self.evaluated = 0

    def nearest(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry."""
        found = [self._block(parts[i : i + _ROWS], to_pivots[i : i + _ROWS]) for i in range(0, len(parts), _ROWS)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _block(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries, apart = self._entries, self._apart
        bound = np.zeros((len(parts), len(entries)))
        for j in range(len(apart)):
            np.maximum(bound, np.abs(to_pivots[:, j, None] - apart[j]), out=bound)
        # a difference of two rounded roots: what rounding may have added is taken off
        bound -= 1e-12 * (to_pivots.max(axis=1, initial=0)[:, None] + apart.max(axis=0, initial=0))
        np.maximum(bound, 0, out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        least = np.take_along_axis(bound, order, axis=1) ** 2
        best = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.zeros(len(parts), np.int64)
        active, at, step = np.arange(len(parts)), 0, _FIRST
        while at < len(entries):
            active = active[least[active, at] <= best[active]]
            if not len(active):
                break
            asked = order[active, at : at + step]
            away = parts[active, None, :] - entries[asked]
            squares = np.einsum("ijk,ijk->ij", away, away)
            self.evaluated += squares.size
            near = squares.min(axis=1)
            first = np.where(squares == near[:, None], asked, len(entries)).min(axis=1)
            better = (near < best[active]) | ((near == best[active]) & (first < index[active]))
            index[active[better]], best[active[better]] = first[better], near[better]
            at += step
        return index, best


def _cut_up(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return matrix(column, parts * width).reshape(len(column), parts, width)


def _with_pivot_distances(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """The rows with ``to_pivots``: the distance of every part to its place's pivots."""
    parts, count = pivots.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _cut_up(batch.column("vector"), parts, width)
            if np.abs(x).max(initial=0) > _LIMIT:
                raise OverflowError(f"components beyond {_LIMIT} have no exact squared distances")
            away = np.concatenate([_distances(x[:, p], pivots[p]) for p in range(parts)], axis=1)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (parts * count))
            lists = pa.ListArray.from_arrays(ends, pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "to_pivots"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, to_pivots array<double>")


def _assigned(batch: pa.RecordBatch, assigners: list[Assigner], count: int, width: int):
    """Parts, and (index, squared distance) of each place, of one batch."""
    parts = len(assigners)
    x = _cut_up(batch.column("vector"), parts, width)
    away = matrix(batch.column("to_pivots"), parts * count, dtype="float64").reshape(len(x), parts, count)
    return x, [a.nearest(x[:, p], away[:, p]) for p, a in enumerate(assigners)]


def _means(table: DataFrame, books: Codebooks) -> np.ndarray:
    """One round: the entries after every part was assigned to its nearest."""
    parts, size, width = books.entries.shape
    count = books.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigners = [Assigner(books.entries[p], books.pivots[p]) for p in range(parts)]
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            x, found = _assigned(batch, assigners, count, width)
            for p, (index, _) in enumerate(found):
                np.add.at(sums[p], index, x[:, p])
                counts[p] += np.bincount(index, minlength=size)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "s"],
            )

    used = table.mapInArrow(run, "part int, entry int, n long, s array<long>").groupBy("part", "entry")
    means = used.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    after = books.entries.copy()
    for p, e, n, s in means.collect():
        after[p, e] = [v // n for v in s]
    return after


def compress_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 1024,
    parts: int = 4,
    size: int = 256,
    rounds: int = 4,
    pivots: int = 12,
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error of every usable row; the codebooks).

    Components are floor(``scale`` * x).  A code has two hex digits for each part,
    ``error`` is the sum of the parts' squared distances to their entries.  The first
    entries are the parts of the ``size`` smallest ids; unused entries stay.

    Defined cases: vectors that are null or hold a null or non-finite component take
    no part; a vector shorter than the longest, or a width that the parts do not
    divide, is filled with zeros; fewer ids than ``size`` give fewer entries; of
    repeated ids the smallest vector is the first entry, and every row is coded; rows
    with a null id are coded and give no first entry unless there is no other; an
    empty table gives no rows and no entries; other columns are not read; a component
    beyond 2**28 is an error.
    """
    if not 1 <= size <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.where(usable(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), quantised(vector_col, scale).alias("vector")
    )
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(size).collect()]
    known = [i for i in ids if i is not None]
    first = rows.where(F.col("vec_id").isin(known) if known else F.col("vec_id").isNull())
    start = [r[1] for r in first.groupBy("vec_id").agg(F.min("vector")).orderBy("vec_id").collect()]
    if not width:  # no rows, or vectors without components: at no distance of one empty entry
        none = np.zeros((parts, min(1, len(start)), 0), np.int64)
        zeros = [F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error")]
        return rows.select("vec_id", "label", *zeros), Codebooks(none, none)
    entries = np.zeros((len(start), parts * width), np.int64)
    for i, v in enumerate(start):
        entries[i, : len(v)] = v
    entries = entries.reshape(len(start), parts, width).swapaxes(0, 1).copy()
    fixed = np.stack([choose_pivots(entries[p], pivots) for p in range(parts)])
    table = cut(_with_pivot_distances(rows, fixed, width), "pivot-distances")
    books = Codebooks(entries, fixed)
    for _ in range(rounds):
        books = Codebooks(_means(table.select("vector", "to_pivots"), books), fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigners = [Assigner(books.entries[p], books.pivots[p]) for p in range(parts)]
        for batch in batches:
            _, found = _assigned(batch, assigners, fixed.shape[1], width)
            places = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            codes = [x.tobytes().hex() for x in places]
            error = np.sum([square for _, square in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with ``label_error``: the errors of all rows with an equal label, nulls together.

    The sums are one row for each label, written first, so that Spark knows their size
    and can split a hot label's rows in the join.
    """
    name = unused(codes, "_label")
    codes = cut(codes, "codes")
    sums = cut(codes.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col(name)), "left").drop(name)
