"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A folder holds, for every non-empty partition ``p`` of the documents in
ascending id order,

* ``ids-ppppp.bin``      the ids of its documents, unsigned little-endian
  integers of 2 bytes (vocabularies up to 65,536 ids) or 4 bytes,
* ``offsets-ppppp.bin``  signed 64-bit: where each document starts in the
  whole corpus, in ids, and after the last one where the partition ends,
* ``docs-ppppp.bin``     signed 64-bit: the document ids,

and ``manifest`` (Parquet): part, n_docs, n_tokens, base, width.  ``base`` is
the prefix sum of ``n_tokens`` over the parts before.  All files are read
through ``numpy.memmap``.

Every file is written under a name of its own task attempt and then renamed,
so a repeated task replaces what a lost one left behind.

Defined cases: a null text is empty; an empty text has the end id only; rows
with a null document id are written first, as id -2**63; repeated ids keep one
entry per row, in any order among them; an empty table gives an empty manifest.
Columns beyond the id and the text are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import mounted_path, per_process, text_or_empty
from sessionscope.llm.tokenization import TextEncoder, as_uint32, by_size

NULL_ID = -(2**63)
_MANIFEST = "part long, n_docs long, n_tokens long, width int"


def _place(folder: str, kind: str, part: int) -> str:
    return os.path.join(folder, f"{kind}-{part:05d}.bin")


def _own(folder: str, kind: str, part: int) -> str:
    return os.path.join(folder, f".{kind}-{part:05d}-{uuid.uuid4().hex}")


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """Encode every document, append ``end_id``, write the folder; returns the manifest.

    One range exchange by document id orders the corpus; a partition is encoded
    in batches and appended to its file, so a task holds one batch.
    """
    spark = docs.sparkSession
    path = mounted_path(folder)
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(lambda: TextEncoder(tokenizer, 800_000, keep_older=False), tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        names = {kind: _own(path, kind, part) for kind in ("ids", "lengths", "docs")}
        n_docs = n_tokens = 0
        files = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not files:
                files = {kind: open(name, "wb") for kind, name in names.items()}
            lengths = []
            for texts in by_size(t.as_py() for t in batch.column(1)):
                for ids in encoder.encode(texts):
                    files["ids"].write(ids)
                    files["ids"].write(end)
                    lengths.append(len(ids) // encoder.width + 1)
            files["lengths"].write(np.array(lengths, "<i8").tobytes())
            files["docs"].write(np.array(batch.column(0).to_pylist(), "<i8").tobytes())
            n_docs += len(lengths)
            n_tokens += sum(lengths)
        for kind, f in files.items():
            f.close()
            os.replace(names[kind], _place(path, kind, part))
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": pa.array([encoder.width], pa.int32())}
            )

    ordered = (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text_or_empty(text_col).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id")
    )
    counted = f"{folder}/counted"
    ordered.mapInArrow(write, _MANIFEST).write.parquet(counted)
    # one row per file: the prefix sum over the parts is a window of that many rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(counted).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{folder}/manifest")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.fromfile(_place(path, "lengths", row["part"]), "<i8")
                starts = np.concatenate([[0], np.cumsum(lengths)]) + row["base"]
                name = _own(path, "offsets", row["part"])
                starts.astype("<i8").tofile(name)
                os.replace(name, _place(path, "offsets", row["part"]))
            yield batch.select(["part"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    _by_part(manifest).mapInArrow(offsets, "part long").write.format("noop").mode("overwrite").save()
    return manifest


def _by_part(manifest: DataFrame) -> DataFrame:
    """The manifest rows, one file or a few to a task."""
    return manifest.repartition("part")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the folder: doc_id, start, n_tokens, ids (uint32 bytes)."""
    path = mounted_path(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, starts, ids in slices(path, row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs, pa.int64(), mask=docs == NULL_ID),
                            pa.array(starts[:-1]),
                            pa.array(np.diff(starts)),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids binary"
    return _by_part(spark.read.parquet(f"{folder}/manifest")).mapInArrow(read, schema)


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`read_token_files`, with the unsigned crc32 in place of the ids."""
    path = mounted_path(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, starts, ids in slices(path, row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs, pa.int64(), mask=docs == NULL_ID),
                            pa.array(starts[:-1]),
                            pa.array(np.diff(starts)),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _by_part(spark.read.parquet(f"{folder}/manifest")).mapInArrow(read, schema)


def slices(path: str, row: dict, at_once: int = 1024) -> Iterator[tuple]:
    """Memory-map one part; yields (doc ids, starts and end, ids of each) of some documents."""
    docs = np.memmap(_place(path, "docs", row["part"]), "<i8", "r")
    starts = np.memmap(_place(path, "offsets", row["part"]), "<i8", "r")
    ids = np.memmap(_place(path, "ids", row["part"]), f"<u{row['width']}", "r")
    for i in range(0, len(docs), at_once):
        edge = np.asarray(starts[i : i + at_once + 1])
        own = [
            as_uint32(ids[a:b].tobytes(), row["width"])
            for a, b in zip(edge[:-1] - row["base"], edge[1:] - row["base"], strict=True)
        ]
        yield np.asarray(docs[i : i + at_once]), edge, own
