"""Quality scores from a byte-level convolutional network in numpy.

A text is its UTF-8 bytes.  Overlapping chunks of 512 bytes, one every 448 and
one at the end, cover it to the last byte.  Within a chunk the 8-byte window at every
byte meets 16 learned filters over learned byte embeddings; each filter keeps
its maximum, and a linear layer turns the 16 maxima into the chunk's logit.  The
document's logit is the mean over its chunks, its score the sigmoid of that.

The network is fitted on the driver on a bounded sample of labelled rows: at most
``sample_per_class`` documents of each class, none longer than ``longest_chars``,
each with its whole text.  Classes weigh the same.  Scoring runs on the executors
over whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sessionscope.llm.common import release, text_or_empty

CHUNK, STEP, BLOCK = 512, 448, 4
EMBEDDING, FILTERS = 4, 16
_SLAB = 256


def chunked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all texts and the number of chunks of each text.

    The last chunk of a text ends with it; a text shorter than a chunk is
    filled up with zero bytes.
    """
    raw = [t.encode("utf-8", "surrogatepass").ljust(CHUNK, b"\0") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = 1 + -(-(sizes - CHUNK) // STEP)
    first = np.cumsum(sizes) - sizes
    within = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    starts = np.repeat(first, counts) + np.minimum(within, np.repeat(sizes - CHUNK, counts))
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(raw), np.uint8), CHUNK)
    return windows[starts], counts


@dataclass
class ByteCnn:
    """Weights: byte embeddings, filters (first and second half of a window), biases, output."""

    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # 2 x (BLOCK * EMBEDDING) x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    offset: np.ndarray  # 1

    @staticmethod
    def start(seed: int) -> ByteCnn:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return ByteCnn(
            normal(0.5, 256, EMBEDDING),
            normal(0.3, 2, BLOCK * EMBEDDING, FILTERS),
            np.zeros(FILTERS, np.float32),
            normal(0.1, FILTERS),
            np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.offset]

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded chunks (n x CHUNK x EMBEDDING) and the filters' responses at every byte, without bias.

        The windows are met in BLOCK rounds, each of those that begin at one remainder.
        """
        n = len(chunks)
        embedded = self.embedding[chunks]
        halves = np.concatenate(list(self.filters), axis=1)
        found = np.empty((n, CHUNK - 2 * BLOCK + 1, FILTERS), np.float32)
        for shift in range(BLOCK):
            blocks = (CHUNK - shift) // BLOCK
            both = embedded[:, shift : shift + blocks * BLOCK].reshape(-1, BLOCK * EMBEDDING) @ halves
            both = both.reshape(n, blocks, 2 * FILTERS)
            found[:, shift::BLOCK] = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
        return embedded, found

    def chunk_logits(self, chunks: np.ndarray) -> np.ndarray:
        logits = np.empty(len(chunks), np.float64)
        for i in range(0, len(chunks), _SLAB):
            _, found = self.responses(chunks[i : i + _SLAB])
            pooled = np.maximum(found.max(axis=1) + self.bias, 0)
            logits[i : i + _SLAB] = pooled @ self.out + self.offset[0]
        return logits

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        scores, held, size = [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size >= 1 << 20 or i == len(texts) - 1:
                chunks, counts = chunked(held)
                ends = np.cumsum(counts)
                total = np.concatenate([[0.0], np.cumsum(self.chunk_logits(chunks))])
                scores.append(_sigmoid((total[ends] - total[ends - counts]) / counts))
                held, size = [], 0
        return np.concatenate(scores) if scores else np.zeros(0)

    def fit(self, texts: list[str], labels: np.ndarray, *, epochs: int, rate: float, seed: int) -> ByteCnn:
        """Adam on the log loss of documents; classes weigh the same."""
        chunks, counts = chunked(texts)
        first = np.cumsum(counts) - counts
        share = np.array([max(1, (labels == c).sum()) for c in (0, 1)]) * 2 / max(1, len(labels))
        rng, weights = np.random.default_rng(seed), self.weights()
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), 32):
                docs = order[i : i + 32]
                rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
                owner = np.repeat(np.arange(len(docs)), counts[docs])
                step += 1
                grads = self._gradients(chunks[rows], owner, counts[docs], labels[docs], share)
                for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, chunks, owner, counts, labels, share) -> list[np.ndarray]:
        embedded, found = self.responses(chunks)
        best = found.argmax(axis=1)  # n x FILTERS
        n = np.arange(len(chunks))[:, None]
        pooled = np.maximum(found[n, best, np.arange(FILTERS)] + self.bias, 0)
        logits = np.bincount(owner, pooled @ self.out, len(counts)) / counts + self.offset[0]
        error = (_sigmoid(logits) - labels) / share[labels] / len(labels)
        chunk_error = (error / counts)[owner].astype(np.float32)
        back = chunk_error[:, None] * self.out * (pooled > 0)  # n x FILTERS
        filters = np.empty_like(self.filters)
        embedding = np.zeros_like(self.embedding)
        for half in (0, 1):
            at = best[:, :, None] + half * BLOCK + np.arange(BLOCK)  # n x FILTERS x BLOCK
            met = embedded[n[:, :, None], at].reshape(*best.shape, BLOCK * EMBEDDING)
            filters[half] = np.einsum("nf,nfd->df", back, met)
            grad = back[:, :, None] * self.filters[half].T[None]  # n x FILTERS x BLOCK*EMBEDDING
            np.add.at(embedding, chunks[n[:, :, None], at], grad.reshape(*best.shape, BLOCK, EMBEDDING))
        return [
            embedding,
            filters,
            back.sum(axis=0),
            pooled.T @ chunk_error,
            np.array([error.sum()], np.float32),
        ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_per_class: int = 800,
    longest_chars: int = 32_768,
    epochs: int = 12,
    rate: float = 0.02,
    seed: int = 7,
) -> ByteCnn:
    """Fit on a bounded sample of the labelled rows that are not held out.

    The sample is the ``sample_per_class`` smallest hashed ids of each class, so
    it is the same on every run; of these, texts of more than ``longest_chars``
    characters do not teach, the others teach whole.  Rows without an id, a label
    or a text do not teach; an id with several labels counts as its largest, one
    with several texts as the smallest of them.  With no row of one
    of the classes the network stays as it starts but for its offset: it scores
    every text as the class that is there (one half with no labels at all).
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    sample = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample_per_class) for c in (0, 1)
    ]
    # at most 2 * sample_per_class rows of two numbers
    chosen = F.broadcast(sample[0].unionByName(sample[1]))
    text = F.col(text_col).cast("string")
    rows = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .where(F.length("text") <= longest_chars)
        .join(chosen, "id")
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["id"])
    texts, y = [r["text"] for r in rows], np.array([r["label"] for r in rows], np.int64)
    model = ByteCnn.start(seed)
    if len(set(y.tolist())) < 2:
        model.out[:] = 0
        model.offset[:] = 0 if len(y) == 0 else (4 if y[0] else -4)
        return model
    return model.fit(texts, y, epochs=epochs, rate=rate, seed=seed)


def scorer(model: ByteCnn) -> Callable[[Column], Column]:
    """A column function: the score of a text column; null is the empty text."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(model.score([t or "" for t in texts]))

    return score


def score_quality(
    docs: DataFrame, model: ByteCnn, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Defined cases: null and empty texts get the score of one chunk of zero
    bytes; a null id is not held out; repeated rows score alike; an empty table
    gives no rows; other columns are never read.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = scored.select("doc_id", held_out("doc_id").alias("held_out"), scorer(model)("text").alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(
    docs: DataFrame, model: ByteCnn, *, text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    return docs.where(scorer(model)(text_or_empty(text_col)) >= threshold)
