"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A BPE model file is compiled into three transducers:

* the normaliser: a text gets the model's dummy prefix, and each space becomes the
  model's space sign;
* the pieces: a trie over the characters of all pieces, one arc per piece;
* byte fallback: a character in no piece becomes the arcs of its UTF-8 bytes.

They are composed with the input: the states are the places in the text, each with
the last piece before it.  A pair of neighbouring pieces weighs 0 when the merges
of their joined text end in just these two pieces, else infinity, and BPE gives
exactly the sequence all of whose neighbours are so (each prefix of a text has
one last piece, and that piece and its predecessor form such a pair).  The
tropical-semiring shortest path is therefore the model's own encoding, and one
pass over the places finds it: at most one state of each place has finite weight.

The trie has failure links: from the longest beginning of a piece that ends at a
place, one step over the next character leads to that of the next place, and a
node lists the pieces that end there.  So a place tries those pieces only.

Weights of pairs are worked out once, when first met.  No piece of the models
supported crosses from another sign into a space sign, so every path passes
through these places, a text falls apart there, and the shortest path of a part is
remembered for the next time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import per_process, text_or_empty

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_INFINITE = float("inf")
_REMEMBERED = 48  # longest part whose path is remembered


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and normaliser settings of a SentencePiece model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in fields:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]))
                self.kinds.append(piece.get(3, _NORMAL))
        trainer = dict(_fields(next((v for n, v in fields if n == 2), b"")))
        normaliser = dict(_fields(next((v for n, v in fields if n == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are compiled")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24):
            raise ValueError("only the identity normaliser with kept, escaped white space is compiled")
        if _USER in self.kinds:
            raise ValueError("user-defined pieces are not compiled")
        self.dummy_prefix = bool(normaliser.get(3, 1))


class Trie:
    """The trie over the characters of all pieces, with failure links; node 0 is its root.

    ``steps[node]`` holds the steps from a node that are known so far: those to its
    children, and those over a failure link once they were taken.  ``ending[node]`` are
    the pieces of two characters or more that end in a node, the longest first, each
    with its length.
    """

    def __init__(self, pieces: Iterable[str]):
        self.steps: list[dict[str, int]] = [{}]
        own: list[tuple[tuple[str, int], ...]] = [()]
        for piece in pieces:
            at = 0
            for sign in piece:
                if sign not in self.steps[at]:
                    self.steps[at][sign] = len(self.steps)
                    self.steps.append({})
                    own.append(())
                at = self.steps[at][sign]
            own[at] = ((piece, len(piece)),) if len(piece) > 1 else ()
        self.ending, self._failure = own, [0] * len(own)
        # from the root on, level by level: a failure link leads to a node nearer to the root
        level = list(self.steps[0].values())
        children = [dict(x) for x in self.steps]
        while level:
            below = []
            for node in level:
                for sign, child in children[node].items():
                    self._failure[child] = self.step(self._failure[node], sign)
                    below.append(child)
                self.ending[node] += self.ending[self._failure[node]]
            level = below

    def step(self, node: int, sign: str) -> int:
        """The node after ``sign``: the longest end of the text that begins a piece."""
        to = self.steps[node].get(sign)
        if to is None:
            to = self.step(self._failure[node], sign) if node else 0
            if to:
                self.steps[node][sign] = to
        return to


class Transducer:
    """The compiled model; see the module's text."""

    def __init__(self, model: Model, max_entries: int = 800_000):
        self._prefix = SPACE if model.dummy_prefix else ""
        self._byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == _BYTE}
        self._unknown = model.kinds.index(_UNKNOWN)
        self._id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (_NORMAL, _UNUSED)}
        self._score = {p: model.scores[i] for p, i in self._id.items()}
        self._pieces, self._kinds = model.pieces, model.kinds
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self._id):
            raise ValueError("a piece crosses into a space sign")
        self._parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self._pair: dict[str, dict[str, float]] = {}
        self._pairs = 0
        self._ends: dict[str, tuple | None] = {}
        # the ids on the path through a part
        self._paths: dict[str, bytes] = {}
        self._max = max_entries
        self._reached = {p for p in self._id if len(p) == 1 or (set(p) != {SPACE} and self._spines(p))}
        self._arcs = {p: self._arc(p) for p in self._reached}
        self._trie = Trie(self._reached)
        # what a piece id writes: its text, or the byte it stands for
        self._written = [
            (b"" if k in (_CONTROL,) else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode())
            for p, k in zip(model.pieces, model.kinds, strict=True)
        ]
        self._written[self._unknown] = " ⁇ ".encode()

    def normalise(self, text: str) -> str:
        return self._prefix + text.replace(" ", SPACE) if text else ""

    def _merges(self, text: str, log: list[tuple[str, str]] | None = None) -> list[str]:
        """BPE merges of a short text: best score first, then leftmost."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                joined = symbols[i] + symbols[j]
                if joined in self._score:
                    heapq.heappush(heap, (-self._score[joined], i, j, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if symbols[i] is None or j >= len(symbols) or after[i] != j or symbols[j] is None or symbols[i] + symbols[j] != joined:
                continue
            if log is not None:
                log.append((symbols[i], symbols[j]))
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def _spines(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What stands at the piece's left and right end while it is merged, with the merge's score.

        From the single character up to the piece; None where merging the piece's
        text does not end in the piece.
        """
        found = self._ends.get(piece, ())
        if found == ():
            if len(piece) == 1:
                found = ([(piece, 0.0)], [(piece, 0.0)])
            else:
                last: list[tuple[str, str]] = []
                found = None
                if self._merges(piece, last) == [piece]:
                    left, right = last[-1]
                    here = (piece, self._score[piece])
                    found = ([*self._spines(left)[0], here], [*self._spines(right)[1], here])
            self._ends[piece] = found
        return found

    def weight(self, left: str, right: str) -> float:
        """0 or infinity, for two neighbouring pieces.

        A piece forms after its parts, so the merges at the border come in the
        order of scores: those that grow the left piece's right end, those that
        grow the right piece's left end, and one across, if the two ends joined
        are a piece.  Of equal scores the leftmost merge comes first.
        """
        known = self._pair.setdefault(left, {})
        if right in known:
            return known[right]
        ends, starts = self._spines(left)[1], self._spines(right)[0]
        i = j = 0
        score = self._score
        result = 0.0
        while True:
            across = score.get(ends[i][0] + starts[j][0], -_INFINITE)
            grow_left = ends[i + 1][1] if i + 1 < len(ends) else -_INFINITE
            grow_right = starts[j + 1][1] if j + 1 < len(starts) else -_INFINITE
            if across > -_INFINITE and across > grow_left and across >= grow_right:
                result = _INFINITE
                break
            if grow_left == grow_right == -_INFINITE:
                break
            if grow_left >= grow_right:
                i += 1
            else:
                j += 1
        if self._pairs >= self._max:
            self._pair.clear()
            self._pairs = 0
        self._pair.setdefault(left, {})[right] = result
        self._pairs += 1
        return result

    def _arc(self, piece: str) -> bytes:
        """The ids an arc writes: the piece's, or those of its bytes."""
        found = self._id.get(piece)
        if found is not None:
            ids = [found]
        elif self._byte:
            ids = [self._byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        else:
            ids = [self._unknown]
        return np.array(ids, "<u4").tobytes()

    def shortest_path(self, part: str) -> list[str]:
        """The pieces (or single characters) on the path of finite weight through ``part``."""
        last = [""]
        steps, ending, step, pairs, weight = self._trie.steps, self._trie.ending, self._trie.step, self._pair, self.weight
        node = 0
        for end, sign in enumerate(part, 1):
            to = steps[node].get(sign)
            node = step(node, sign) if to is None else to
            for piece, size in ending[node]:
                left = last[end - size]
                if not left:
                    break
                known = pairs[left].get(piece) if left in pairs else None
                if (weight(left, piece) if known is None else known) == 0.0:
                    break
            else:
                piece, left = sign, last[end - 1]
                if left and weight(left, piece) != 0.0:
                    return self._merges(part)  # only where scores tie
            last.append(piece)
        path, at = [], len(part)
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def _ids(self, part: str) -> bytes:
        """The ids of a part, remembered unless it is long."""
        # pieces of space signs alone share one score; their ties are settled leftmost, by merging
        path = self._merges(part) if part.startswith(SPACE * 2) else self.shortest_path(part)
        arcs = self._arcs
        ids = b"".join([arcs.get(p) or self._arc(p) for p in path])
        if len(part) <= _REMEMBERED:
            if len(self._paths) >= self._max:
                self._paths.clear()
            self._paths[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = self._parts(self.normalise(text))
        found = list(map(self._paths.get, parts))
        if None in found:
            known = self._paths
            found = [known.get(p) or self._ids(p) if x is None else x for p, x in zip(parts, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes joined, the dummy prefix taken off."""
        written = self._written
        text = b"".join([written[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self._prefix and text.startswith(" ") else text


def compiled(path: str) -> Transducer:
    return per_process(lambda: Transducer(Model(path)), path)


def encode_texts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids (binary, little-endian unsigned 32-bit) of every whole text.

    Defined cases: a null text is empty and has no ids; a null id stays null;
    repeated rows are encoded each; an empty table gives no rows; other columns
    are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [transducer.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_ids", "ids"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(encode, "doc_id long, n_ids long, ids binary")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of a table of doc_id, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [transducer.decode(x.as_py() or b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip: encoded, decoded and compared in one pass."""
    import hashlib

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                ids = transducer.encode(text)
                back = transducer.decode(ids)
                sha = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(ids) // 4, zlib.crc32(ids), sha, back == text))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(both, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
