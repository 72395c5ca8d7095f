"""Token ids of whole texts with the ``tokenizers`` library.

Encoding cost is dominated by the BPE merges of each word, and words repeat.
Where a tokenizer never merges across a white-space boundary, a text is cut at
such boundaries, each distinct piece is encoded by the library once per worker
and the ids of a text are the concatenation.  Many texts are cut at once, as an
Arrow column, whose distinct pieces alone come to Python.  The result equals
encoding the whole text (tests compare both); tokenizers of any other build get
whole texts.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Python counts these as white space, the library does not
_SEPARATORS = "\x1c\x1d\x1e\x1f"
# a word with the space before it, or white space as the library's byte-level pattern cuts it
_WITH_SPACE = re.compile(r" ?\S+|\s+(?!\S)|\s").findall
# a word with the white space after it
_WITH_REST = re.compile(r"\S+\s*|\s+").findall
# white space of one byte, looked up by byte, and of more bytes (there is none above the last)
_WHITE_BYTES = np.isin(np.arange(256), np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
_WIDE_WHITE = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_LONG = 64
# letters whose lower case and composed form are the same everywhere, then signs but the apostrophe
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIGNS = "!-&(-/:-@\\[-`{-~"
_SHORT_TAIL = 3


def _byte_signs() -> dict[int, str]:
    """The sign by which byte-level vocabularies write each byte: itself where it can be seen, else from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_SIGNS = "".join(_byte_signs()[b] for b in range(256))


def _as_byte_signs(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", _BYTE_SIGNS)[0]


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizer file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    """The pattern by which the installed rank vocabularies cut texts into words."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _cuts_at(config: dict) -> str | None:
    """How texts may be cut: ``dropped`` (white space carries nothing),
    ``attached`` (it leads the next word) or None (not at all)."""
    pre = config.get("pre_tokenizer") or {}
    normalizer = config.get("normalizer")
    if (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and normalizer is None
    ):
        return "attached"
    steps = pre.get("pretokenizers") or [{}]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    kinds = {n.get("type") for n in (normalizer or {}).get("normalizers", [])}
    if (
        pre.get("type") == "Sequence"
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert")
        and not steps[1].get("use_regex", True)
        and not steps[1].get("add_prefix_space", True)
        and r"[^\s\p{L}\p{N}]+" in pattern
        and r"\s+" not in pattern
        and kinds <= {"NFC", "Replace", "Lowercase"}
    ):
        return "dropped"
    return None


class TextEncoder:
    """Ids of texts as little-endian unsigned integers, ``width`` bytes each.

    ``width`` is 2 for vocabularies of at most 65,536 ids, else 4.  About
    ``max_entries`` parts are remembered, and with ``keep_older`` as many older ones; a part that was
    not met since the last change of generations is forgotten.
    """

    def __init__(self, path: str, max_entries: int = 700_000, keep_older: bool = True):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # strings of special tokens inside a text are ordinary text
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            cut = _cuts_at(json.load(f))
        self._split = {"attached": _WITH_SPACE, "dropped": _WITH_REST}.get(cut)
        # a separator that is one token of its own, and the sign in it that other parts lack
        self._separator, self._sign = {"attached": ("\n", "\n"), "dropped": (" | ", "|")}.get(cut, ("", ""))
        mark = self._ids([self._sign])[0] if self._sign else []
        self._mark = mark[0] if len(mark) == 1 else None
        self.width = id_width(self._tokenizer.get_vocab_size())
        self._kind = f"<u{self.width}"
        # a run of letters and a run of signs after it: two pieces, which go to the merges as they are
        self._lower = cut == "dropped"
        self._word = re.compile(f"({'' if self._lower else ' ?'}[{_LETTERS}]+)([{_SIGNS}]*)").fullmatch if self._plain_runs(cut) else None
        self._merges = self._tokenizer.model.tokenize
        self._raw = [i.to_bytes(self.width, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._tails: dict[str, bytes] = {"": b""}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._max, self._keep_older = max_entries, keep_older

    def _plain_runs(self, cut: str | None) -> bool:
        """Whether the library makes two pieces of every letter of ``_LETTERS`` and every sign of ``_SIGNS`` in a row."""
        if cut is None:
            return False
        every = "".join(map(chr, range(256)))
        letters, signs = ("".join(re.findall(f"[{x}]", every)) for x in (_LETTERS, _SIGNS))
        lead = "" if cut == "dropped" else " "
        text = lead + letters + signs
        if self._tokenizer.normalizer is not None:
            text = self._tokenizer.normalizer.normalize_str(text)
        made = [piece for piece, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return made == [_as_byte_signs(lead + (letters.lower() if cut == "dropped" else letters)), signs]

    def _merged(self, piece: str) -> bytes:
        raw = self._raw
        return b"".join([raw[t.id] for t in self._merges(piece)])

    def _of_word(self, letters: str, tail: str) -> bytes:
        """Ids of a run of letters and of the signs after it; a run known without signs is not merged again."""
        ids = self._known.get(letters) if tail else None
        if ids is None:
            ids = self._merged(_as_byte_signs(letters.lower() if self._lower else letters))
        found = self._tails.get(tail)
        if found is None:
            found = self._merged(tail)
            if len(tail) <= _SHORT_TAIL:
                self._tails[tail] = found
        return ids + found

    def _ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(x, self._kind).tobytes() for x in self._ids(parts)]

    def _fresh(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts: words go to the merges; of the rest, those without the separator's sign in one call, joined by it."""
        found: dict[str, bytes] = {}
        if self._word is not None:
            word, of_word, rest = self._word, self._of_word, set()
            for p in parts:
                m = word(p)
                if m:
                    found[p] = of_word(*m.groups())
                else:
                    rest.add(p)
            parts = rest
        plain = [p for p in parts if self._sign not in p and not p.isspace()]
        other = [p for p in parts if self._sign in p or p.isspace()]
        if self._mark is None or len(plain) < 2:
            other, plain = list(parts), []
        if other:
            found.update(zip(other, self._each(other), strict=True))
        if plain:
            ids = np.array(self._ids([self._separator.join(plain)])[0], self._kind)
            ends = np.flatnonzero(ids == self._mark)
            if len(ends) != len(plain) - 1:
                raise AssertionError("a part holds the separator's token")
            raw, step = ids.tobytes(), self.width
            starts = [0, *((ends + 1) * step).tolist()]
            stops = [*(ends * step).tolist(), len(raw)]
            found.update(zip(plain, [raw[i:j] for i, j in zip(starts, stops, strict=True)], strict=True))
        return found

    def _parts(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The parts of all texts in a row, as ``self._split`` cuts them, and where the parts of each text start and the last end."""
        raw = [t.encode() for t in texts]
        edges = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        octets = np.frombuffer(data, np.uint8)
        filled = edges[:-1][edges[1:] > edges[:-1]]
        white = _WHITE_BYTES[octets]
        after_white = np.zeros(len(octets), bool)
        after_white[1:] = white[:-1]
        if self._lower:
            begins = after_white & ~white
        else:
            # white space starts a part where its run starts and where a word follows, a word where no single space leads it
            before_word = np.zeros(len(octets), bool)
            before_word[:-1] = ~white[1:]
            before_word[filled[1:] - 1] = False
            begins = white & (before_word | ~after_white)
            begins[1:] |= after_white[1:] & ~white[1:] & (octets[:-1] != ord(" "))
        begins[filled] = True
        for t, a, b in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if not t.isascii() and any(x in t for x in _WIDE_WHITE):
                begins[a:b] = False
                begins[np.cumsum([a, *(len(p.encode()) for p in self._split(t)[:-1])])] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(octets)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        return parts, np.searchsorted(starts, edges)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        if len(self._known) > self._max:
            self._older, self._known = (self._known if self._keep_older else {}), {}
        known, older = self._known, self._older
        whole = [self._split is None or any(x in t for x in _SEPARATORS) for t in texts]
        parts, edges = self._parts(["" if w else t for t, w in zip(texts, whole, strict=True)])
        coded = parts.dictionary_encode()
        # asks once for each part of these texts, so its work does not grow with what is remembered
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self._lower:
            distinct = [p.strip() for p in distinct]
            known[""] = b""
        ids = list(map(known.get, distinct))
        missing = {p for p, got in zip(distinct, ids, strict=True) if got is None}
        again = [p for p in missing if p in older]
        known.update((p, older[p]) for p in again)
        missing.difference_update(again)
        fresh = self._fresh(missing) if missing else {}
        known.update(fresh)
        ids = [known[p] if got is None else got for p, got in zip(distinct, ids, strict=True)]
        rows = pa.array(ids, pa.large_binary()).take(coded.indices)
        raw, stops = b"", [0] * len(edges)
        if len(rows):
            raw = rows.buffers()[2].to_pybytes()
            stops = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset :][edges].tolist()
        out = [self._each([t])[0] if w else raw[a:b] for t, w, a, b in zip(texts, whole, stops[:-1], stops[1:], strict=True)]
        for p in fresh:
            if len(p) > _LONG:
                del known[p]
        return out


def by_size(texts: Iterable[str], characters: int = 1 << 21) -> Iterator[list[str]]:
    """Texts in lists of about so many characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def id_width(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


def as_uint32(ids: bytes, width: int) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
