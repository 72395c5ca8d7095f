"""The transducer against the sentencepiece library."""

import random

import numpy as np
import pytest
import sentencepiece

from sessionscope.llm import sp_transducer
from sessionscope.llm.tokenization import vocabulary_path
from tests.llm import edge

PATH = vocabulary_path("piece_bpe_32k.model")
SIGNS = ["abcdefghijklmnopqrstuvwxyz ", "  \n\tab", "éàüßñ <s>▁ 　ﬁ中文😀ab", "the of and ing tion er "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("max_entries", [60, 10**6])
def test_encode_and_decode_equal_the_library(library, max_entries):
    transducer = sp_transducer.Transducer(sp_transducer.Model(PATH), max_entries)
    r = random.Random(3)
    texts = ["".join(r.choice(s) for _ in range(r.randrange(30))) for s in SIGNS for _ in range(2500)]
    texts += ["x" * 500, "a" * 999, "tionthe" * 60, "中" * 70, *[t or "" for _, t in edge.ROWS]]
    for text in texts:
        ids = transducer.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert transducer.decode(ids) == library.decode(library.encode(text)) == text.replace("▁", " "), text


def test_the_path_is_the_only_one_of_finite_weight(library):
    """All segmentations of short texts: exactly one has weight 0, the model's own."""
    transducer = sp_transducer.Transducer(sp_transducer.Model(PATH))
    known = transducer._id

    def paths(text):
        if not text:
            yield []
        for i in range(1, len(text) + 1):
            if text[:i] in known and (i == 1 or transducer._spines(text[:i])):
                for rest in paths(text[i:]):
                    yield [text[:i], *rest]

    for part in ("▁these", "▁nation", "aaaa", "▁restoring", "singing"):
        finite = [p for p in paths(part) if all(transducer.weight(a, b) == 0 for a, b in zip(p, p[1:]))]
        assert finite == [transducer.shortest_path(part)]


def test_tables(spark, library):
    rows = edge.ROWS
    docs = edge.docs(spark, rows)
    encoded = sp_transducer.encode_texts(docs, PATH)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()), key=key)
    assert got == sorted(((d, library.encode(t or "")) for d, t in rows), key=key)
    texts = sorted(((r.doc_id, r.text) for r in sp_transducer.decode_ids(encoded, PATH).collect()), key=key)
    assert texts == sorted(((d, t or "") for d, t in rows), key=key)
    both = sp_transducer.round_trips(docs, PATH).collect()
    assert len(both) == len(rows) and all(r.round_trip for r in both)
    assert sp_transducer.round_trips(edge.docs(spark, []), PATH).count() == 0


def test_a_place_tries_the_pieces_that_end_there(library):
    """The trie against all pieces; of a text, its parts alone are remembered."""
    transducer = sp_transducer.Transducer(sp_transducer.Model(PATH))
    trie, known = transducer._trie, transducer._reached
    r = random.Random(7)
    texts = ["".join(r.choice(s) for _ in range(r.randrange(1, 40))) for s in SIGNS for _ in range(300)]
    for text in (transducer.normalise(t) for t in texts):
        node = 0
        for end, sign in enumerate(text, 1):
            node = trie.step(node, sign)
            ends = [text[i:end] for i in range(end - 1) if text[i:end] in known]
            assert [p for p, _ in trie.ending[node]] == ends
            assert all(len(p) == n for p, n in trie.ending[node])
    fresh = sp_transducer.Transducer(sp_transducer.Model(PATH))
    text = "these restored nations these restoring nations"
    assert np.frombuffer(fresh.encode(text), "<u4").tolist() == library.encode(text)
    assert set(fresh._paths) == {"▁" + w for w in text.split()}
