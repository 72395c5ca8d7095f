"""What the operators share: table access, shared folders, grouped batches."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.session import ensure_checkpoint_dir


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    For a driver that was started elsewhere and put the package on its own path.
    A cluster whose machines do not share that path gets the package as usual,
    with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, shared by all executors.

    The name is unique, so two applications on one checkpoint root never meet.
    """
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def mounted_path(uri: str) -> str:
    """The file-system path of a shared folder; needed where files are memory-mapped."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(
            f"memory-mapped files need a shared folder that is mounted as a path, not {uri!r}"
        )
    return parsed.path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks only, and what
    was numbered or sampled before the cut stays as it was.  The planner knows
    the size of the files, so it broadcasts only what is small.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str) -> Column:
    """The text column as string, null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def runs(
    batches: Iterable[pa.RecordBatch], key: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``key`` of sorted Arrow batches, one table each."""
    held: list[pa.Table] = []
    held_key: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        keys = list(zip(*(rows[k].to_pylist() for k in key), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held_key is not None and keys[start] != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = keys[start]
            held.append(rows.slice(start, i - start))
            start = i
    if held_key is not None:
        yield held_key, pa.concat_tables(held)


def per_process(make: Callable[[], object], key: str) -> object:
    """``make()`` once per Python worker; later calls with ``key`` reuse it."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


_MADE: dict[str, object] = {}


def release() -> None:
    """Forget what ``per_process`` made and give the memory back to the system.

    Python workers outlive tasks.  Operators that make nothing of the kind call this in
    their tasks, so that the vocabularies and remembered words of an earlier operator do
    not stand beside what they need.
    """
    if not _MADE:
        return
    _MADE.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give:
        give(0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table of integer ids.

    Returns (node, component): every node that has an edge, with the smallest
    node id of its component.  Large-star / small-star rounds, each a grouping
    with partial aggregation; every round is written to the shared folder.  A
    hub only meets its neighbours through ``min``, never as a collected list.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    seen = _print(e)
    while True:
        # large star: every neighbour larger than u moves to the smallest of u's neighbours and u.
        # low is written first: a join of two plain exchanges is one whose hot key Spark can split
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u"), F.col("m").alias("v")),
                )
            )
        )
        e = cut(small.where("u <> v").distinct(), "star")
        now = _print(e)
        if now == seen:  # a table of stars maps to itself
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _print(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of an edge table."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "v"))).first())


def matrix(column: pa.Array, width: int, fill: int = 0, dtype: str = "int64") -> np.ndarray:
    """A list column as rows of ``width`` numbers; missing trailing ones are ``fill``."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill, dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
