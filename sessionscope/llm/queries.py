"""The registered queries ``opN_<name>``, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm import (
    bpe_replay,
    chebyshev_whitening,
    chunk_dedup,
    ngram_join,
    packing,
    pivot_codes,
    quality_cnn,
    reply_trees,
    sp_transducer,
    threshold_topk,
    token_files,
    url_trust,
    warc_index,
)
from sessionscope.llm.common import shared_dir, show_package, table
from sessionscope.llm.tokenization import vocabulary_path, word_pattern

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# a conversation whose texts hold the template's own control strings
CONTROL_CONVERSATION, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trust.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k_inner_product(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc_index.write_archives(table(spark, sf_dir, "pages"), folder)
    index = warc_index.merged_index(warc_index.read_archives(spark, folder))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position"
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(
        table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), capacity=2048
    )
    return packing.with_id_digests(packed)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_transducer.round_trips(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_cnn.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score_quality(docs, model)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    chats = reply_trees.format_chats(reply_trees.linear_replies(turns.unionByName(control)))
    read = chats.select(
        "conv_id",
        reply_trees.parsed_turns(F.col("formatted")).alias("turns"),
        reply_trees.learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary_path("byte_bpe_50k.json"))
    return token_files.document_digests(spark, folder)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return chebyshev_whitening.whiten(vectors, chebyshev_whitening.fit_whitening(vectors, components=16))


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_replay.encode_documents(table(spark, sf_dir, "documents"), vocabulary, word_pattern(), decoded=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = pivot_codes.compress_vectors(table(spark, sf_dir, "embeddings"), parts=4, size=256, rounds=4)
    return pivot_codes.with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


Query = Callable[[SparkSession, str], DataFrame]


def _shown(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        show_package(spark)
        return query(spark, sf_dir)

    return run


_OPERATORS: dict[str, Query] = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_exact_topk": op4_exact_topk,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_byte_level_bpe": op12_byte_level_bpe,
    "op13_vector_codes": op13_vector_codes,
}

QUERIES: dict[str, Query] = {name: _shown(query) for name, query in _OPERATORS.items()}
