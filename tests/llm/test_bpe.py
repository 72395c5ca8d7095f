"""Merge replay against the tiktoken library, and the round trip."""

import gc
import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken

from sessionscope.llm import bpe_replay
from sessionscope.llm.queries import QUERIES
from sessionscope.llm.tokenization import vocabulary_path, word_pattern
from tests.conftest import DATA_SMALL
from tests.llm import edge

PATH = vocabulary_path("byte_bpe_multi_50k.tiktoken")
PIECES = [
    *"abentios", "A", "é", "中", "文", "1", "2", " ", "  ", "\n", "\x1c", "\x1f", "\x85", "​", "᠎", "😀",
    "'s", "'re", "<|endoftext|>", "ción", "the", "ing", " ", "　", "\r\n", "´",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe_replay.read_ranks(bpe_replay.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def merges(ranks):
    return bpe_replay.Merges(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(merges, library):
    r = random.Random(11)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * n for n in range(70)] + ["ab" * 300, "aab" * 500, "=" * 997, " " * 501, "é" * 333, "the" * 400]
    texts += ["".join(r.choice("abent") for _ in range(3000)) for _ in range(10)]
    got = bpe_replay.Encoder(merges, word_pattern()).encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_words_are_forgotten_and_learnt_again(merges, library, monkeypatch):
    monkeypatch.setattr(bpe_replay, "_KEPT", 2000)
    r = random.Random(12)
    encoder = bpe_replay.Encoder(merges, word_pattern())
    for _ in range(20):
        texts = ["".join(r.choice(PIECES) for _ in range(40)) for _ in range(20)]
        assert [g.tolist() for g in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert encoder._kept <= 2000 + 40_000


def test_forgotten_words_do_not_wait_for_the_garbage_collector(merges, monkeypatch):
    """Workers live on from task to task, and the collector seldom runs there."""
    monkeypatch.setattr(bpe_replay, "_KEPT", 0)
    held = lambda: [w for d in gc.get_objects() if isinstance(d, defaultdict) for w in ("qwxz", "zxwq") if w in d]
    gc.collect()
    gc.disable()
    try:
        encoder = bpe_replay.Encoder(merges, word_pattern())
        for text in ("qwxz", "zxwq"):
            assert len(list(encoder.encode([text]))) == 1
        del text
        assert "qwxz" not in held()
        del encoder
        assert held() == []
    finally:
        gc.enable()


def test_ids_are_those_of_their_block_when_taken_late(merges, library, monkeypatch):
    monkeypatch.setattr(bpe_replay, "_KEPT", 0)
    encoder = bpe_replay.Encoder(merges, word_pattern())
    first, second = encoder.encode(["some qwxz words"]), encoder.encode(["other zxwq texts", ""])
    assert [x.tolist() for x in second] == [library.encode_ordinary("other zxwq texts"), []]
    assert [x.tolist() for x in first] == [library.encode_ordinary("some qwxz words")]


def test_rows_keep_their_ids_where_a_block_is_returned_in_parts(spark, library, monkeypatch):
    """Long and short texts, null and empty ones at the edges of parts."""
    monkeypatch.setattr(bpe_replay, "_OUT", 40)
    r = random.Random(14)
    texts = [r.choice(["", None, "a", "the qwxz", "é " * 30, f"number {i} of many " * r.randint(1, 9)]) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    back = bpe_replay.encode_documents(docs, PATH, word_pattern(), decoded=True).collect()
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in back}
    assert len(back) == len(rows)
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), ids, t or "")


def slow(word, ranks):
    """The lowest pair first, of equal ones the left; one merge at a time."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_a_vocabulary_whose_new_pairs_have_lower_ranks():
    """Ranks in random order: the merge order must be kept word by word."""
    r = random.Random(13)
    for _ in range(40):
        tokens = list({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(25)})
        r.shuffle(tokens)
        every = [bytes([b]) for b in range(256)]
        ranks = {t: i for i, t in enumerate(tokens)} | {t: 1000 + i for i, t in enumerate(every)}
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 25))) for _ in range(150)] + [b"a" * 40, b"ab" * 30]
        ids, counts = bpe_replay.replay(words, bpe_replay.Merges(ranks))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [slow(w, ranks) for w in words]


def test_whole_texts_in_spark(spark, library):
    docs = edge.docs(spark).repartition(3)
    encoded = bpe_replay.encode_documents(docs, PATH, word_pattern())
    back = bpe_replay.decode_documents(encoded, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in back), key=key)
    want = sorted(((i, t or "") for i, t in edge.ROWS), key=key)
    assert got == [(i, t, library.encode_ordinary(t), len(library.encode_ordinary(t))) for i, t in want]
    both = bpe_replay.encode_documents(docs, PATH, word_pattern(), decoded=True).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in both), key=key) == got
    assert bpe_replay.encode_documents(edge.docs(spark, []), PATH, word_pattern()).count() == 0


def test_blocks_hold_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 1, 1, 9)])], names=["t"])
    parts = list(bpe_replay.blocks_of(batch, 0, 10))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="bytes"):
        bpe_replay.Merges({b"a": 0})


def test_query(spark, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op12_byte_level_bpe"](spark, DATA_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
