"""Held-out accuracy and edge cases of the convolutional classifier."""

import numpy as np
from pyspark.sql import functions as F

from sessionscope.llm import quality_cnn
from tests.conftest import DATA_ORACLE
from tests.llm import edge


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"{DATA_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_cnn.score_quality(docs, quality_cnn.fit_quality(docs, known))
    rows = scored.join(known, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert np.mean(right) >= 0.93
    kept = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(kept) >= 0.97
    assert scored.where("score < 0 or score > 1 or score is null").isEmpty()


def test_held_out_rows_and_text_columns_do_not_teach(spark):
    docs = spark.read.parquet(f"{DATA_ORACLE}/documents.parquet")
    known = spark.read.parquet(f"{DATA_ORACLE}/labels.parquet")
    turned = known.withColumn("quality", F.when(quality_cnn.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    fit = lambda d, k: quality_cnn.fit_quality(d, k, sample_per_class=40, epochs=2)
    a = fit(docs, known)
    b = fit(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)), turned)
    for x, y in zip(a.weights(), b.weights()):
        assert np.array_equal(x, y)


def test_edge_texts_empty_tables_and_missing_classes(spark):
    docs = edge.docs(spark)
    model = quality_cnn.fit_quality(docs, labels(spark, [(6, 1, 0), (10, 0, 0), (99, 1, 0), (None, 0, 0), (7, None, 1)]), epochs=2)
    out = quality_cnn.score_quality(docs, model).collect()
    assert len(out) == len(edge.ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id: r.held_out for r in out}[None] is False
    empty = quality_cnn.fit_quality(docs, labels(spark, []))
    assert {r.score for r in quality_cnn.score_quality(docs, empty).collect()} == {0.5}
    only_good = quality_cnn.fit_quality(docs, labels(spark, [(6, 1, 0)]))
    kept = quality_cnn.keep_quality(docs, only_good)
    assert kept.columns == docs.columns and kept.count() == len(edge.ROWS)
    assert quality_cnn.score_quality(edge.docs(spark, []), model).count() == 0


def test_chunks_cover_every_byte():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        chunks, counts = quality_cnn.chunked(["".join(chr(33 + i % 90) for i in range(size))])
        assert counts.sum() == len(chunks)
        starts = [min(i * quality_cnn.STEP, max(0, size - quality_cnn.CHUNK)) for i in range(len(chunks))]
        assert starts[-1] + quality_cnn.CHUNK >= size
        assert all(b - a <= quality_cnn.STEP for a, b in zip(starts, starts[1:]))


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    model = quality_cnn.ByteCnn.start(3)
    chunks, counts = quality_cnn.chunked(["some text " * 80, "OTHER!! " * 90, "a"])
    labels_ = np.array([1, 0, 1])
    owner = np.repeat(np.arange(3), counts)
    share = np.ones(2)

    def loss():
        logits = np.bincount(owner, model.chunk_logits(chunks)) / counts
        p = quality_cnn._sigmoid(logits)
        return -np.mean(np.where(labels_ == 1, np.log(p), np.log(1 - p)))

    grads = model._gradients(chunks, owner, counts, labels_, share)
    for w, g in zip(model.weights(), grads):
        flat, found = w.reshape(-1), g.reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(found) > 1e-3), 3) if (np.abs(found) > 1e-3).any() else []:
            was, step = flat[i], 1e-2
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - found[i]) < 0.05 * max(0.02, abs(found[i])) + 2e-3


def test_scores_equal_a_plain_network():
    """Window by window and byte by byte, without any of the model's own steps."""
    model = quality_cnn.ByteCnn.start(11)
    model.out *= 20
    whole = np.concatenate(list(model.filters)).astype(np.float64)  # 8 bytes x EMBEDDING, FILTERS

    def plain(text):
        raw = text.encode().ljust(512, b"\0")
        starts = sorted({*range(0, len(raw) - 511, 448), len(raw) - 512})
        logits = []
        for start in starts:
            best = [-np.inf] * 16
            for at in range(start, start + 505):
                window = np.concatenate([model.embedding[b] for b in raw[at : at + 8]]).astype(np.float64)
                for f in range(16):
                    best[f] = max(best[f], float(window @ whole[:, f]))
            logits.append(sum(max(0.0, m + float(b)) * float(o) for m, b, o in zip(best, model.bias, model.out)) + float(model.offset[0]))
        return 1 / (1 + np.exp(-np.mean(logits)))

    texts = ["", "short", "é中😀 " * 60, "one passage, " * 90, "x" * 961]
    assert np.allclose(model.score(texts), [plain(t) for t in texts], atol=1e-4)


def test_a_passage_counts_at_every_alignment():
    """One learned window, alone in a text, is met wherever it begins."""
    model = quality_cnn.ByteCnn.start(2)
    whole = np.concatenate(list(model.filters))
    word = b"ABCDEFGH"
    model.filters[:] = 0
    target = np.concatenate([model.embedding[b] for b in word])
    model.filters[0, :, 0], model.filters[1, :, 0] = target[: len(whole) // 2], target[len(whole) // 2 :]
    model.out[:] = 1
    scores = {round(float(model.chunk_logits(quality_cnn.chunked(["." * at + "ABCDEFGH" + "." * (600 - at)])[0]).max()), 3) for at in range(9)}
    assert len(scores) == 1


def test_whole_texts_teach_and_longer_rows_do_not(spark):
    """The deciding word stands in the middle of a long text; texts past the bound are left out."""
    rows = [(i, "plain words here " * 150 + ("GOODGOOD " * 40 if i % 2 else "badbadbad " * 40) + "plain words here " * 150) for i in range(60)]
    known = labels(spark, [(i, i % 2, 0) for i in range(60)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_cnn.fit_quality(docs, known, epochs=60)
    out = quality_cnn.score_quality(docs, model).collect()
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 1) for r in out]) >= 0.95
    bounded = quality_cnn.fit_quality(docs, known, longest_chars=100)
    assert {r.score for r in quality_cnn.score_quality(docs, bounded).collect()} == {0.5}
