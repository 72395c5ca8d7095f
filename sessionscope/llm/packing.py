"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids.  A bin is filled by
minimum bin slack: the longest piece left goes in first, then a bitset
subset-sum over the lengths still available finds the fullest feasible
combination beside it, and that combination is removed.

Pieces of one length are interchangeable, so the search runs over the histogram
of lengths: at most ``capacity`` numbers, whatever the size of the corpus.  A
combination is removed as often as the counts allow before the next search (the
search would return it again), so at least one length drops below its use in
it and the number of searches is bounded by the capacity, not by the rows.
Where the bins are more than the total length asks for, the last of them are also
tried by best fit, over the same histogram (:func:`plan_bins`).

On Spark: one pass encodes and cuts the documents and numbers the pieces of each
length within their task; the numbers are written with the rows.  A grouping by
(task, length) and a prefix sum over tasks turn them into ranks within the
length; the rank finds its bin and offset in the plan.  No text or id meets the
driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import cut, per_process, text_or_empty
from sessionscope.llm.tokenization import TextEncoder, as_uint32, by_size

_WIDTH = 4  # bytes of a stored id
_PIECES = "id long, piece int, start long, length int, width int, ids binary, task long, nth long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The fullest combination of the available ``lengths`` (descending) within ``room``.

    Bit s of the set says that a total of s can be made.  Returns (length, copies).
    """
    reach, steps, want = 1, [], 1 << room
    inside = (want << 1) - 1
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            grown = (reach | reach << (length * copies)) & inside
            if grown != reach:
                steps.append((length, copies, reach))
                reach = grown
            left -= copies
            copies *= 2
        if reach & want:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            total -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return sorted(chosen.items(), reverse=True)


Plan = list[tuple[int, list[tuple[int, int]]]]
_TURNS = 16  # places of the plan from which best fit is tried


def minimum_slack(histogram: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack over a histogram of lengths: (number of bins, [(length, copies)])."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(counts, reverse=True)
    plan = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        rest = fullest(order if counts[longest] else order[1:], counts, capacity - longest)
        counts[longest] += 1
        inside = dict(rest)
        inside[longest] = inside.get(longest, 0) + 1
        times = min(counts[k] // c for k, c in inside.items())
        for k, c in inside.items():
            counts[k] -= times * c
        plan.append((times, sorted(inside.items(), reverse=True)))
        order = [k for k in order if counts[k]]
    return plan


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit over a histogram of lengths, the longest first; bins of one content are one row."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    open_rooms: list[int] = []

    def put(times: int, inside: dict[int, int], room: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(open_rooms, room)
        rooms[room].append((times, inside))

    for length in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(open_rooms, length)
            if at < len(open_rooms):
                room = open_rooms[at]
                times, inside = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], open_rooms[at]
            else:
                room, times, inside = capacity, left, {}
            # a bin that took a piece has the least room of all, so it takes them until it is full
            copies = min(left, room // length)
            taken = min(times, left // copies)
            put(taken, {**inside, length: copies}, room - copies * length)
            if inside and times > taken:
                put(times - taken, inside, room)
            left -= taken * copies
    return [(times, sorted(inside.items(), reverse=True)) for row in rooms.values() for times, inside in row]


def plan_bins(histogram: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack; where it needs more bins than the total asks for, its end goes by best fit if that saves bins.

    Minimum slack spends the short pieces first, and long ones left alone fill bins badly.
    """
    plan = minimum_slack(histogram, capacity)
    bins = lambda rows: sum(times for times, _ in rows)
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best = plan
    for turn in range(_TURNS - 1, -1, -1):
        if bins(best) <= least:
            break
        head = plan[: len(plan) * turn // _TURNS]
        rest = dict(histogram)
        for times, inside in head:
            for length, copies in inside:
                rest[length] -= times * copies
        tried = head + best_fit(rest, capacity)
        if bins(tried) < bins(best):
            best = tried
    return best


class Slots:
    """Where the n-th piece of a length goes: by binary search in the plan."""

    def __init__(self, plan: Plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first_bin = 0
        for times, inside in plan:
            at = 0
            for length, copies in inside:
                rows.setdefault(length, []).append((used.get(length, 0), first_bin, copies, at))
                used[length] = used.get(length, 0) + times * copies
                at += length * copies
            first_bin += times
        self._by_length = {k: np.array(v, np.int64).T for k, v in rows.items()}
        self.bins = first_bin

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for value, rows in zip(values, np.split(order, starts[1:]), strict=True):
            first, first_bin, copies, at = self._by_length[int(value)]
            step = np.searchsorted(first, rank[rows], "right") - 1
            within = rank[rows] - first[step]
            bins[rows] = first_bin[step] + within // copies[step]
            offsets[rows] = at[step] + within % copies[step] * value
        return bins, offsets


def token_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int, id_col: str, text_col: str, end_id: int
) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids, numbered per length within the task."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(lambda: TextEncoder(tokenizer), tokenizer)
        task, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        size, seen = capacity * _WIDTH, {}
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for texts in by_size(t.as_py() for t in batch.column(1)):
                rows = []
                for ids in encoder.encode(texts):
                    doc, ids = next(docs), as_uint32(ids, encoder.width) + end
                    for piece, at in enumerate(range(0, len(ids), size)):
                        own = ids[at : at + size]
                        length = len(own) // _WIDTH
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, piece, at // _WIDTH, length, _WIDTH, own, task, nth))
                yield _batch(rows, _ARROW)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(cut_up, _PIECES)


_ARROW = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("task", pa.int64()), ("nth", pa.int64())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, piece, start, length, width, ids (binary,
    little-endian unsigned integers of ``width`` bytes), sequence_id, offset.

    Defined cases: a null text is empty; an empty text is one piece, the end id;
    a null id stays null; repeated rows are packed once each; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = cut(
        token_pieces(docs, tokenizer, capacity=capacity, id_col=id_col, text_col=text_col, end_id=end_id), "pieces"
    )
    counts = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    # at most `capacity` rows, whatever the corpus holds
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(plan_bins(histogram, capacity))
    # a window group has one row per task that wrote pieces of the length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    # lengths and ranks alone go through Python; the ids stay where they are
    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offsets = slots.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    return ranked.withColumn("at", placed("length", "rank")).select(
        F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "width", "ids",
        "at.sequence_id", "at.offset",
    )


def with_id_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned crc32 of their ids in place of the ids.

    Defined cases: null ids have a null crc32; repeated pieces are kept; an empty table gives
    no rows; other columns are not read.
    """
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
