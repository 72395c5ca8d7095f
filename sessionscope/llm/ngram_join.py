"""N-gram Jaccard self-join: an LSH forest, an exact prefix filter, exact similarities.

A document is the set of its word 5-grams (lower-cased words between white
space; a shorter text is one gram).  Two documents are linked when the Jaccard
similarity of their sets reaches the threshold; a class is a connected
component of links.

1.  Equal sets collapse to one representative with a number of copies.
2.  The forest: each tree has an ordered label per document, one byte of each of
    ``longest_prefix`` MinHash values that no other tree uses.  Sorted labels are the
    tree's prefix trie: documents that share a prefix stand side by side in it.
    Matched prefixes are shortened, from whole labels on, until the target share of
    the linked pairs in a sample meets in some tree (:func:`_depth`).  The shortest
    prefix allowed is the one at which a pair at the threshold meets with the target
    recall (:func:`shortest_prefix`).
3.  The pairs that no tree brings together are found by an exact prefix filter
    (:func:`_prefix_ties`), so that every linked pair is tied.  A document is tied to
    the smallest one of its label or gram, and a label to the one before it in its
    trie, never to all others; the connected components of these ties are the
    candidate groups.
4.  A group is cut into blocks of bounded size, and each pair of blocks is one
    cell.  A cell computes the exact similarity of all its pairs from the texts
    and returns, per document, its number of links and a root, never the pairs.
5.  The components of (document, root) are the classes; link counts are summed.

Only the texts of candidates meet a cell, and a cell holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import components, cut, release, runs, text_or_empty, unused

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int):
        self._n = n
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self._power = np.cumprod(np.full(size, _BASE, np.uint64))
            self._back = np.cumprod(np.full(size, _INVERSE, np.uint64))

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) >= len(self._power):
            self._grow(2 * len(raw))
        # hash of the bytes i..j: difference of prefix sums, moved back to place 0
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self._power[: len(raw)], out=sums[1:])
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.append(gaps, len(raw))
        if len(words) > self._n:
            starts, ends = starts[: 1 - self._n], ends[self._n - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        return np.unique(_mix((sums[ends] - sums[starts]) * self._back[starts]))


def shortest_prefix(threshold: float, trees: int, longest: int, target: float) -> int:
    """The longest prefix at which a pair at ``threshold`` meets with the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class Forest:
    """Labels of a document: for each tree one byte of every MinHash value, in the tree's order.

    No two trees share a hash, so they meet independently, as :func:`shortest_prefix`
    counts.  One byte tells two unequal values apart in 255 of 256 cases; the others
    make candidates, never links.
    """

    def __init__(self, trees: int, longest: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self._factors = (rng.integers(0, 1 << 63, trees * longest, np.uint64) << np.uint64(1)) | np.uint64(1)

    def labels(self, grams: np.ndarray) -> bytes:
        """The labels of all trees, one after the other."""
        least = np.full(len(self._factors), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 256):
            least = np.minimum(least, (self._factors[:, None] * grams[None, i : i + 256]).min(axis=1))
        return (_mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


_SIGNED = "row long, doc_id long, text_hash long, n_grams int, set_key binary, labels binary"


def _signed(docs: DataFrame, n: int, forest: Forest) -> DataFrame:
    """Every document with the key of its gram set and its labels."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        release()
        shingle = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys, labels = [], [], []
                for text in part.column(3):
                    grams = shingle(text.as_py())
                    sizes.append(len(grams))
                    keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                    labels.append(forest.labels(grams) if len(grams) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(labels, pa.binary())],
                    names=["row", "doc_id", "text_hash", "n_grams", "set_key", "labels"],
                )

    return docs.select("row", "doc_id", "text_hash", "text").mapInArrow(sign, _SIGNED)


def _shared(a: Column, b: Column, levels: int) -> Column:
    """Bytes that two columns have in common from the first on."""
    same = F.lit(0)
    for level in range(levels, 0, -1):
        same = F.when(F.substring(a, level, 1) == F.substring(b, level, 1), same + 1).otherwise(0)
    return same


def _forest_ties(texts: DataFrame, reps: DataFrame, n: int, threshold: float, trees: int, longest: int, target: float, sample: int) -> DataFrame:
    """Ties (a, b) of documents whose labels share a prefix of the chosen length in some tree.

    Only documents that share the shortest prefix with another are sorted into the
    tries.  A label of several documents stands there once, and below one shortest
    prefix there are at most 256 to the power of the levels left, so no run that a
    task sorts grows with the table.
    """
    shortest = shortest_prefix(threshold, trees, longest, target)
    below = longest - shortest

    def leaf(t: int) -> Column:
        """The shortest prefix, hashed with its tree, and the levels of the label below it."""
        node = F.xxhash64(F.lit(t), F.substring("labels", t * longest + 1, shortest))
        return F.struct(node.alias("node"), F.substring("labels", t * longest + 1 + shortest, below).alias("label"))

    leaves = reps.select("rep", F.inline(F.array(*[leaf(t) for t in range(trees)])))
    crowded = leaves.groupBy("node").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    leaves = cut(leaves.join(cut(crowded.select("node"), "nodes"), "node"), "leaves")
    trie = Window.partitionBy("node").orderBy("label")
    sorted_labels = leaves.groupBy("node", "label").agg(F.min("rep").alias("least"))
    sorted_labels = sorted_labels.withColumn("above", F.lag("least").over(trie)).withColumn("before", F.lag("label").over(trie))
    sorted_labels = cut(
        sorted_labels.select("node", "label", "least", "above", (shortest + _shared(F.col("label"), F.col("before"), below)).alias("levels")), "trie"
    )
    same = leaves.join(sorted_labels.select("node", "label", "least"), ["node", "label"]).where("rep <> least")
    beside = sorted_labels.where("above is not null")
    ties = same.select(F.col("rep").alias("a"), F.col("least").alias("b"), F.lit(longest).alias("levels")).unionByName(
        beside.select(F.greatest("least", "above").alias("a"), F.least("least", "above").alias("b"), "levels")
    )
    ties = cut(ties.groupBy("a", "b").agg(F.max("levels").alias("levels")), "ties")
    depth = _depth(texts, reps, ties, n, threshold, trees, longest, shortest, target, sample)
    return ties.where(F.col("levels") >= depth).select("a", "b")


def _depth(
    texts: DataFrame, reps: DataFrame, ties: DataFrame, n: int, threshold: float, trees: int, longest: int, shortest: int, target: float, sample: int
) -> int:
    """The longest prefix at which the target share of linked pairs meets in some tree.

    The pairs are a sample: neighbours in the tries at the shortest prefix, those with
    the ``sample`` smallest hashes, of which the linked ones count.  Without any, the
    shortest prefix is taken.  The share is one of the pairs that the shortest prefix
    finds; what it misses is left to the prefix filter.
    """
    pairs = cut(ties.orderBy(F.xxhash64("a", "b"), "a", "b").limit(sample).select("a", "b"), "sample")
    ends = pairs.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("end")), F.struct(F.col("b").alias("end")))))
    ends = ends.join(reps.select("rep", "doc_id", "text_hash", "labels"), F.col("end") == F.col("rep"))
    # written, so that the planner knows that these few rows may be broadcast
    ends = cut(ends.select("a", "b", "end", "labels", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), "ends")
    wanted = texts.join(ends, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    wanted = wanted.select("a", "b", "end", "labels", "text").repartition("a", "b").sortWithinPartitions("a", "b")

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for (a, b), pair in runs(batches, ["a", "b"]):
            found = {r["end"]: r for r in pair.select(["end", "labels", "text"]).to_pylist()}  # repeated rows are one end
            grams = [shingle(found[x]["text"]) for x in (a, b)]
            common = len(np.intersect1d(*grams, assume_unique=True))
            if common < threshold * (len(grams[0]) + len(grams[1]) - common) - 1e-6:
                continue
            equal = np.equal(*[np.frombuffer(found[x]["labels"], np.uint8).reshape(trees, longest) for x in (a, b)])
            yield pa.RecordBatch.from_pydict({"levels": pa.array([int(equal.cumprod(axis=1).sum(axis=1).max())], pa.int32())})

    # one row per number of levels
    linked = {r["levels"]: r["pairs"] for r in wanted.mapInArrow(levels, "levels int").groupBy("levels").agg(F.count("*").alias("pairs")).collect()}
    depth = longest
    while depth > shortest and sum(k for x, k in linked.items() if x >= depth) < max(1, target * sum(linked.values())):
        depth -= 1
    return depth


_POSTINGS = 1_000_000  # postings of a bucket, and those a task holds before it sends them
_DEALT = "bucket int, grams binary, ids binary, met binary, local binary, credits binary"


def _common(size: Column, threshold: float) -> Column:
    """Grams that a document of ``size`` grams shares with every linked one, at least."""
    return F.greatest(F.lit(1), F.ceil(size * threshold - 1e-6)).cast("int")


def _extra(common: Column, size: Column) -> Column:
    """Shared grams asked for within the prefix; grows with the size."""
    return F.least(common, (1 + F.floor(size / 10)).cast("int"))


def _deal(batches: Iterator[pa.RecordBatch], n: int, threshold: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings (gram, set id) of every text's prefix, dealt over buckets by gram.

    The prefix are the smallest hashes.  A gram that several sets of this part
    have is credited to them here and sent once, as met, so a gram of all
    documents is not sent by all of them.
    """
    import hashlib

    shingle = Shingler(n)
    held: dict[int, np.ndarray] = {}
    turn = 0

    def send() -> pa.RecordBatch:
        nonlocal turn
        grams = np.concatenate(list(held.values()))
        ids = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
        own, place, seen = np.unique(grams, return_inverse=True, return_counts=True)
        many = seen[place] > 1
        local, credits = np.unique(ids[many], return_counts=True)
        grams, ids, met = grams[~many], ids[~many], own[seen > 1]
        at, met_at = _mix(grams) % np.uint64(buckets), _mix(met) % np.uint64(buckets)
        order, met_order = np.argsort(at, kind="stable"), np.argsort(met_at, kind="stable")
        grams, ids, met = grams[order], ids[order], met[met_order]
        edges = np.arange(buckets + 1, dtype=np.uint64)
        cuts, met_cuts = np.searchsorted(at[order], edges), np.searchsorted(met_at[met_order], edges)
        rows = [b for b in range(buckets) if cuts[b] < cuts[b + 1] or met_cuts[b] < met_cuts[b + 1]]
        part = lambda x, c: [x[c[b] : c[b + 1]].tobytes() for b in rows]
        once = turn % len(rows)
        turn += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array(part(grams, cuts), pa.binary()),
                pa.array(part(ids, cuts), pa.binary()),
                pa.array(part(met, met_cuts), pa.binary()),
                pa.array([local.tobytes() if i == once else b"" for i in range(len(rows))], pa.binary()),
                pa.array([credits.astype(np.int64).tobytes() if i == once else b"" for i in range(len(rows))], pa.binary()),
            ],
            names=["bucket", "grams", "ids", "met", "local", "credits"],
        )

    count = 0
    for batch in batches:
        for text in batch.column(0):
            grams = shingle(text.as_py())
            if not len(grams):
                continue
            key = int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=16).digest()[:8], "big", signed=True)
            if key in held:
                continue
            common = max(1, int(np.ceil(len(grams) * threshold - 1e-6)))
            held[key] = grams[: len(grams) - common + min(common, 1 + len(grams) // 10)]
            count += len(held[key])
            if count >= _POSTINGS:
                yield send()
                held, count = {}, 0
    if held:
        yield send()


def _credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set id, 1) for each of its prefix grams that another set's prefix has, and what was counted before."""
    for _, part in runs(batches, ["bucket"]):
        read = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
        grams, ids, met = read("grams", np.uint64), read("ids", np.int64), np.unique(read("met", np.uint64))
        order = np.lexsort((ids, grams))
        grams, ids = grams[order], ids[order]
        if len(grams):
            new = np.ones(len(grams), bool)  # a set that came twice counts once
            new[1:] = (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])
            grams, ids = grams[new], ids[new]
        _, place, seen = np.unique(grams, return_inverse=True, return_counts=True)
        found = ids[(seen[place] > 1) | np.isin(grams, met)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([found, read("local", np.int64)])),
                pa.array(np.concatenate([np.ones(len(found), np.int64), read("credits", np.int64)])),
            ],
            names=["id", "credits"],
        )


def _prefix_ties(texts: DataFrame, reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """Ties (a, b) that connect every pair of ``reps`` whose similarity reaches the threshold.

    Of two linked sets, each has all but a few of its grams in common with the
    other (:func:`_common`).  In any order that holds for all sets, therefore,
    the first grams of both, as many as these few and k more, share at least k.

    First in the order of hashes, which needs no counting: a set of which too few
    prefix grams are met in any other prefix has no partner.  Then, among the
    rest only, from the rarest gram on, so that boilerplate comes last: sets that
    share one prefix gram are tied.  Nothing is sampled and no gram is dropped.
    """
    size = F.col("n_grams")
    longest = size - _common(size, threshold) + _extra(_common(size, threshold), size)
    total = reps.agg(F.sum(longest.cast("long"))).first()[0] or 0
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _POSTINGS))
    dealt = texts.select("text").mapInArrow(lambda batches: _deal(batches, n, threshold, buckets), _DEALT)
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    credits = dealt.mapInArrow(_credit, "id long, credits long").groupBy("id").agg(F.sum("credits").alias("credits"))
    # a partner has _common grams at least, so both prefixes have the _extra of that size
    least = _common(size, threshold)
    met = reps.select("rep", "set_id", "doc_id", "text_hash", "n_grams").join(credits, F.col("set_id") == F.col("id"))
    met = met.where(F.col("credits") >= _extra(_common(least, threshold), least)).drop("set_id", "id", "credits")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                grams = [shingle(text.as_py()).view(np.int64) for text in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(grams, pa.list_(pa.int64()))], names=["rep", "n_grams", "grams"]
                )

    wanted = texts.join(
        met.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")),
    )
    # rows that repeat an id and its text are one document
    wanted = wanted.select("rep", "n_grams", "text").dropDuplicates(["rep"])
    sets = wanted.mapInArrow(shingled, "rep long, n_grams int, grams array<long>")
    postings = cut(sets.select("rep", "n_grams", F.explode("grams").alias("gram")), "postings")
    seen = postings.groupBy("gram").agg(F.count("*").alias("seen")).where("seen > 1")
    shared = postings.join(seen, "gram")
    # grams of one set only come first; they leave this many places to the others
    both = Window.partitionBy("rep")
    places = size - _common(size, threshold) + 1 - (size - F.count("*").over(both))
    place = F.row_number().over(both.orderBy("seen", "gram"))
    prefix = cut(
        shared.withColumn("places", places).withColumn("place", place).where("place <= places").select("gram", "rep"),
        "prefix",
    )
    least_rep = prefix.groupBy("gram").agg(F.min("rep").alias("least"))
    return prefix.join(least_rep, "gram").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) of sets whose Jaccard similarity reaches the threshold.

    Without ``b``: the pairs i < j within ``a``.
    """
    own = b is None
    sets = a if own else [*a, *b]
    sizes = np.array([len(s) for s in sets])
    left = slice(0, len(a))
    right = left if own else slice(len(a), len(sets))
    _, codes, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    # grams of one set only add nothing to an intersection; the others are numbered anew
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[codes]
    codes, rows = number[codes[keep]], rows[keep]
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    common = np.zeros((len(a), right.stop - right.start), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(codes, (first, first + 4096))
        bits = np.zeros((len(sets), 4096), np.float32)
        bits[rows[lo:hi], codes[lo:hi] - first] = 1
        common += bits[left] @ bits[right].T
    either = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= threshold * either - 1e-6
    if own:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def _verify(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each cell, per linked document: a root of its links in the cell, and their number."""
    shingle = Shingler(n)
    for (_, i, j), cell in runs(batches, ["group", "i", "j"]):
        members: dict[int, tuple[int, int, np.ndarray]] = {}
        for row in cell.select(["rep", "copies", "block", "text"]).to_pylist():
            if row["rep"] not in members:
                members[row["rep"]] = (row["block"], row["copies"], shingle(row["text"]))
        reps = sorted(members)
        sides = [[r for r in reps if members[r][0] == k] for k in ((i,) if i == j else (i, j))]
        if not all(sides) or len(reps) < 2:
            continue
        sets = [[members[r][2] for r in side] for side in sides]
        x, y = linked_pairs(sets[0], sets[1] if i != j else None, threshold)
        if not len(x):
            continue
        ids = [np.array(side) for side in sides]
        weight = [np.array([members[r][1] for r in side]) for side in sides]
        other = -1 if i != j else 0
        links: dict[int, int] = {}
        for mine, theirs, side, far in ((x, y, 0, other), (y, x, other, 0)):
            total = np.bincount(mine, weight[far][theirs], len(ids[side])).astype(np.int64)
            for k in np.flatnonzero(total):
                links[int(ids[side][k])] = links.get(int(ids[side][k]), 0) + int(total[k])
        root = {r: r for r in links}

        def top(r: int) -> int:
            while root[r] != r:
                root[r] = root[root[r]]
                r = root[r]
            return r

        for p, q in zip(ids[0][x].tolist(), ids[other][y].tolist(), strict=True):
            p, q = top(p), top(q)
            root[max(p, q)] = min(p, q)
        yield pa.RecordBatch.from_pydict(
            {"rep": list(links), "root": [top(r) for r in links], "links": list(links.values())}
        )


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.9,
    trees: int = 12,
    longest_prefix: int = 10,
    sample_pairs: int = 2000,
    block_docs: int = 256,
    block_grams: int = 400_000,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, class_size.

    ``class_id`` is the smallest document id of the class, ``n_links`` the number
    of other documents linked to this one (copies count each), ``class_size`` the
    number of documents of the class.

    Defined cases: a null text is empty; a text without a word has no grams and
    is linked to nothing, so its class is itself; a text of fewer than ``n``
    words is one gram and linked to texts of the same words; repeated rows are
    linked; a null id counts as larger than every other in ``class_id``; an empty
    table gives no rows; other columns of ``docs`` are not read.

    ``sample_pairs`` bounds the pairs by which the forest chooses how far prefixes
    are shortened; no link depends on it.
    """
    texts = _texts(docs, id_col, text_col)
    signed, resolved = _resolved(
        texts, texts.withColumn("row", F.monotonically_increasing_id()), n=n, threshold=threshold,
        target_recall=target_recall, trees=trees, longest_prefix=longest_prefix, sample_pairs=sample_pairs, block_docs=block_docs, block_grams=block_grams,
    )
    return signed.select("doc_id", "set_key").join(resolved, "set_key", "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.withColumn("text_hash", F.xxhash64("text"))


def _resolved(
    texts: DataFrame,
    tagged: DataFrame,
    *,
    n: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.9,
    trees: int = 12,
    longest_prefix: int = 10,
    sample_pairs: int = 2000,
    block_docs: int = 256,
    block_grams: int = 400_000,
) -> tuple[DataFrame, DataFrame]:
    """Every row of ``tagged`` (``texts`` with a row tag) with the key of its gram set, and the classes of the sets.

    The second: set_key, copies, links, component (the class), class_id, class_size.
    """
    signed = cut(_signed(tagged, n, Forest(trees, longest_prefix)), "signed")

    sets = cut(
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("low_id")),
        "sets",
    )
    own = signed.join(
        sets.select(F.col("set_key").alias("k"), "rep", "copies"),
        (F.col("set_key") == F.col("k")) & (F.col("row") == F.col("rep")),
    )
    set_id = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")
    reps = cut(own.select("rep", set_id.alias("set_id"), "copies", "doc_id", "text_hash", "n_grams", "labels"), "reps")

    # candidates: documents tied by the forest or by a gram
    ties = _forest_ties(texts, reps, n, threshold, trees, longest_prefix, target_recall, sample_pairs)
    ties = ties.unionByName(_prefix_ties(texts, reps, n, threshold)).distinct()
    grouped = components(ties).withColumnsRenamed({"node": "rep", "component": "group"})
    candidates = cut(reps.drop("labels", "set_id").join(grouped, "rep"), "candidates")

    # cells: pairs of blocks of a group
    blocks = F.greatest(
        F.ceil(F.count("*") / block_docs), F.ceil(F.sum(F.col("n_grams").cast("long")) / block_grams)
    ).cast("int")
    sized = cut(candidates.groupBy("group").agg(blocks.alias("blocks")), "groups")
    celled = (
        candidates.join(sized, "group")
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group", "rep", "copies", "doc_id", "text_hash", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    wanted = texts.join(
        celled.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")),
    ).select("group", "i", "j", "rep", "copies", "block", "text")
    cells = wanted.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    verified = cut(
        cells.mapInArrow(lambda batches: _verify(batches, n, threshold), "rep long, root long, links long"), "links"
    )

    classes = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    found = (
        sets.join(classes, F.col("rep") == F.col("node"), "left")
        .drop("node")
        .join(links, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    found = cut(found, "found")
    whole = cut(
        found.groupBy("component").agg(F.min("low_id").alias("class_id"), F.sum("copies").alias("class_size")), "classes"
    )
    return signed, cut(found.join(whole, "component").drop("low_id", "rep"), "resolved")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class, that with the smallest id, with all its columns.

    Of rows of a class with one id, one stays; a null id counts as larger than
    every other.  A row is found again by its id and the hash of its text, so the
    texts are not written a second time; of rows that have both in common one is
    taken.  A text without a word is in a class of its own, so all such rows stay.
    """
    texts = _texts(docs, id_col, text_col)
    signed, resolved = _resolved(texts, texts.withColumn("row", F.monotonically_increasing_id()))
    rows = signed.join(resolved.select("set_key", "component"), "set_key", "left").select("row", "doc_id", "text_hash", "component")
    alike = rows.where("component is not null").groupBy("component", "doc_id", "text_hash")
    alike = alike.agg(F.min("row").alias("row"), F.count("*").alias("alike"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash", "alike")).alias("first")
    stay = alike.groupBy("component").agg(first).select("first.doc_id", "first.text_hash", "first.alike")
    wordless = rows.where("component is null").select("doc_id", "text_hash").distinct()
    stay = cut(stay.unionByName(wordless.withColumn("alike", F.lit(1).cast("long"))), "stay")

    own_id, own_hash, stay_id, stay_hash = (unused(docs, x) for x in ("_id", "_hash", "_stay_id", "_stay_hash"))
    hashed = docs.withColumn(own_id, F.col(id_col).cast("long")).withColumn(own_hash, F.xxhash64(text_or_empty(text_col)))

    def found(some: DataFrame) -> DataFrame:
        # a merge at every size, as the rows that stay are too many to broadcast where the table is large
        keys = some.select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash)).hint("merge")
        return hashed.join(keys, F.col(own_id).eqNullSafe(F.col(stay_id)) & (F.col(own_hash) == F.col(stay_hash)), "left_semi")

    kept = found(stay.where("alike = 1"))
    several = stay.where("alike > 1")
    if not several.isEmpty():
        kept = kept.unionByName(found(several).dropDuplicates([own_id, own_hash]))
    return kept.drop(own_id, own_hash)
