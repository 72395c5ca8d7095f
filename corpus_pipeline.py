"""The corpus pipeline: quality, exact duplicates, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.  Part of the ``llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionscope.llm import chunk_dedup, ngram_join, packing, quality_cnn
from sessionscope.llm.common import cut, show_package, table
from sessionscope.llm.tokenization import vocabulary_path

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of these documents."""
    model = quality_cnn.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.keep_quality(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return chunk_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays."""
    return ngram_join.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences."""
    packed = packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), capacity=CAPACITY)
    return packing.with_id_digests(packed)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pack", pack)]

# a network's scores and MinHash candidates are not SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    show_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
