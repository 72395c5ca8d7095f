"""Byte-level BPE of whole texts by replaying the merges over a corpus of words.

Texts are cut by the vocabulary's pattern.  A task takes its documents in blocks of
bounded size; the distinct words of a block that are not known yet form one corpus,
their bytes in one array.  An inverted index leads from a merge (its rank) to the
places where its pair stands.  The merges are applied in rank order, each to all its
places at once; only the two neighbours of a merged place get new pairs, which enter
the index.  A document's ids are those of its words, in order.  Nothing is shuffled.

What the order must keep, and how:

* a pair belongs to the merge that makes its joined bytes, whatever its two parts, as
  a rank vocabulary defines it;
* of equal merges that overlap in a word, the left one is applied;
* a new pair may have a lower rank than the merge that made it.  It is then next in
  its word, so the word's later places of the merge go back into the index.

Words that are a token of the vocabulary are that token, without merges.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import per_process, text_or_empty, trim

_NONE = np.iinfo(np.int32).max
_BLOCK = 1 << 22  # bytes of the texts of a block of documents
_OUT = 1 << 20  # bytes of the texts whose ids are returned at once
_KEPT = 1 << 24  # bytes of words and ids that are remembered between the blocks of a task


def read_ranks(text: bytes) -> dict[bytes, int]:
    """Tokens and ranks of the lines of a rank vocabulary (a base64 token and its rank each)."""
    pairs = [line.split() for line in text.splitlines() if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Tokens:
    """The bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        written = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            written[rank] = token
        self._lengths = np.array([len(t) for t in written], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(written), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, in order."""
        return gathered(self._bytes, self._starts[ids], self._lengths[ids]).tobytes()


class Merges:
    """Ranks of the tokens, and for every token the merges with it on the left and on the right."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks the bytes {lacking}")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right = defaultdict(list), defaultdict(list)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left[a].append((b, rank))
                    right[b].append((a, rank))
        self.after = {a: _sorted(x) for a, x in left.items()}
        self.before = {b: _sorted(x) for b, x in right.items()}
        # the pairs of single bytes as a table
        self.of_pair = np.full((256, 256), _NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_pair[token[0], token[1]] = rank


def _sorted(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    other, rank = zip(*sorted(pairs), strict=True)
    return np.array(other, np.int32), np.array(rank, np.int32)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _ranks(table: tuple[np.ndarray, np.ndarray] | None, tokens: np.ndarray) -> np.ndarray:
    """The rank of each token's merge with the table's token, or none."""
    if table is None:
        return np.full(len(tokens), _NONE, np.int32)
    other, rank = table
    at = np.minimum(np.searchsorted(other, tokens), len(other) - 1)
    return np.where(other[at] == tokens, rank[at], _NONE)


class _Index:
    """Places by rank; ``next_rank`` empties itself in rank order."""

    def __init__(self):
        self._places: dict[int, list[np.ndarray]] = {}
        self._heap: list[int] = []

    def add(self, places: np.ndarray, ranks: np.ndarray) -> None:
        """New places with their ranks; those without a rank are left out."""
        held, heap = self._places, self._heap
        some = ranks != _NONE
        places, ranks = places[some], ranks[some]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for i, rank in enumerate(ranks[cuts[:-1]].tolist()):
            part = places[cuts[i] : cuts[i + 1]]
            if rank in held:
                held[rank].append(part)
            else:
                held[rank] = [part]
                heapq.heappush(heap, rank)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        while self._heap:
            rank = heapq.heappop(self._heap)
            parts = self._places.pop(rank)
            yield rank, np.sort(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])


def _lone(places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of places that overlap the one before them, every second one goes."""
    touching = following[places[:-1]] == places[1:]
    if not touching.any():
        return places
    starts = np.concatenate([[True], ~touching])
    since = np.arange(len(places)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return places[since % 2 == 0]


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one behind the other, number of ids of each word).

    Every merge of the vocabulary is applied in rank order to all its places in the
    words.  An empty word has no ids.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # a fence of no token before every word and behind the last
    starts = np.cumsum(lengths + 1) - lengths
    size = int(lengths.sum()) + len(words) + 1
    token = np.full(size, -1, np.int32)
    raw = np.zeros(size, np.uint8)
    inner = np.ones(size, bool)
    inner[starts - 1] = inner[-1] = False
    raw[inner] = np.frombuffer(b"".join(words), np.uint8)
    token[inner] = merges.of_byte[raw[inner]]
    following, previous = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
    rank_at = np.full(size, _NONE, np.int32)
    pairs = np.flatnonzero(inner[:-1] & inner[1:])
    rank_at[pairs] = merges.of_pair[raw[pairs], raw[pairs + 1]]
    index = _Index()
    index.add(pairs.astype(np.int32), rank_at[pairs])
    after, before = merges.after, merges.before
    for rank, places in index:
        places = places[rank_at[places] == rank]
        if not len(places):
            continue
        table_after, table_before = after.get(rank), before.get(rank)
        if len(places) > 1:
            every, places = places, _lone(places, following)
            if table_after is not None or table_before is not None:
                lower = _makes_lower(places, rank, token, following, previous, table_after, table_before)
                if lower.any():
                    # in its word such a place is the last for now: the lower pair is merged before the next place
                    last = np.full(len(starts) + 1, _NONE, np.int64)
                    np.minimum.at(last, np.searchsorted(starts, places[lower], side="right"), places[lower])
                    wait = every > last[np.searchsorted(starts, every, side="right")]
                    index.add(every[wait], np.full(int(wait.sum()), rank, np.int32))
                    places = places[places <= last[np.searchsorted(starts, places, side="right")]]
        right = following[places]
        behind = following[right]
        token[places] = rank
        token[right] = -1
        rank_at[right] = _NONE
        following[places] = behind
        previous[behind] = places
        ahead = previous[places]
        new_after = _ranks(table_after, token[behind])
        new_before = _ranks(table_before, token[ahead])
        rank_at[places] = new_after
        # a fence has no pair; where two merged places meet, both sides name the same pair
        inside = token[ahead] >= 0
        ahead, new_before = ahead[inside], new_before[inside]
        rank_at[ahead] = new_before
        apart = token[ahead] != rank
        index.add(np.concatenate([places, ahead[apart]]), np.concatenate([new_after, new_before[apart]]))
    left = np.flatnonzero(token >= 0)
    count = np.searchsorted(left, starts + lengths) - np.searchsorted(left, starts)
    return token[left], count


def _makes_lower(places, rank, token, following, previous, table_after, table_before) -> np.ndarray:
    """Which places, applied from the left one by one, make a pair of lower rank than their own."""
    right = following[places]
    lower = _ranks(table_after, token[following[right]]) < rank
    # the token ahead is the merge itself where the place before ends there
    joined = np.zeros(len(places), bool)
    joined[1:] = following[right[:-1]] == places[1:]
    return lower | (_ranks(table_before, np.where(joined, rank, token[previous[places]])) < rank)


def unicode_spaces(pattern: str) -> str:
    """The pattern with white space as Unicode has it; Python adds four separators."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Encoder:
    """Ids of documents, block by block; words are replayed once while they are remembered."""

    def __init__(self, merges: Merges, pattern: str):
        import regex

        self._merges = merges
        self._find = regex.compile(unicode_spaces(pattern)).findall
        self._forget()

    def _forget(self) -> None:
        # the next number from a counter: a dict that holds its own length method is a ring, which
        # only the garbage collector frees, and that seldom runs among strings and arrays
        self._number: defaultdict[str, int] = defaultdict(count().__next__)
        self._ids = np.empty(0, np.int32)
        self._counts = np.empty(0, np.int64)
        self._kept = 0

    def _learn(self) -> None:
        """Ids of the words that were met since the last call."""
        known = len(self._counts)
        fresh = [w.encode("utf-8", "surrogatepass") for w in list(self._number)[known:]]
        if not fresh:
            return
        whole = [self._merges.ranks.get(w) for w in fresh]
        cut = [i for i, r in enumerate(whole) if r is None]
        counts = np.ones(len(fresh), np.int64)
        ids, counts[cut] = replay([fresh[i] for i in cut], self._merges)
        flat = np.empty(int(counts.sum()), np.int32)
        one = np.zeros(len(fresh), bool)
        one[[i for i, r in enumerate(whole) if r is not None]] = True
        at_one = np.repeat(one, counts)
        flat[at_one] = [r for r in whole if r is not None]
        flat[~at_one] = ids
        self._ids = np.concatenate([self._ids, flat])
        self._counts = np.concatenate([self._counts, counts])
        self._kept += sum(map(len, fresh)) + 4 * len(flat)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of every text of a block."""
        if self._kept > _KEPT:
            self._forget()
        number = self._number
        words = []
        for text in texts:
            found = self._find(text)
            words.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        self._learn()
        ids, counts = self._ids, self._counts
        starts = np.cumsum(counts) - counts
        return (gathered(ids, starts[w], counts[w]).astype("<u4") for w in words)


def blocks_of(batch: pa.RecordBatch, column: int, characters: int = _BLOCK) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about so many bytes; a longer text is alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > characters:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def read_vocabulary(path: str) -> bytes:
    """The lines of a rank vocabulary on the driver's disk; every task gets them with its function."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every whole text.

    With ``decoded`` also the bytes that the ids decode to, from the same worker.

    ``vocabulary`` is the path of a rank vocabulary, ``pattern`` cuts texts into words;
    text between matches carries no ids.

    Defined cases: a null text is empty and has no ids; a null id stays null; repeated
    rows are encoded each; an empty table gives no rows; a text longer than a block is
    a block of its own; strings of special tokens are ordinary text; other columns are
    not read.
    """
    lines = read_vocabulary(vocabulary)
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tables of the vocabulary stay with the worker, the words of a task do not
        encoder = Encoder(per_process(lambda: Merges(read_ranks(lines)), f"merges of {vocabulary}"), pattern)
        tokens = per_process(lambda: Tokens(read_ranks(lines)), f"tokens of {vocabulary}") if decoded else None
        for batch in batches:
            for block in blocks_of(batch, 1):
                found = encoder.encode(x.as_py() for x in block.column(1))
                for part in blocks_of(block, 1, _OUT):
                    ids = list(islice(found, part.num_rows))
                    columns = [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ]
                    if tokens:
                        columns.append(pa.array([tokens.decode(x) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                trim()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(
        encode, "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decoded else "")
    )


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The encoded rows with ``decoded``, the bytes of their ids.

    Defined cases: null ids have null bytes, no ids have none; other columns stay.
    """
    lines = read_vocabulary(vocabulary)
    at = encoded.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_process(lambda: Tokens(read_ranks(lines)), f"tokens of {vocabulary}")
        for batch in batches:
            for part in blocks_of(batch, at):
                ids = [x.as_py() for x in part.column(at)]
                found = [None if x is None else known.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "decoded"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(decode, f"{fields}, decoded binary")
