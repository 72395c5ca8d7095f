"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so: after a line or sentence end, at
least 512 and at most 4,096 characters from the last cut.  A long document is
never moved; it becomes its recipe, the ordered list of its chunks' identifiers.

Chunks are grouped by (identifier, content), so every distinct chunk moves once
at most and an identifier that two different contents share shows up.  Such an
identifier is not verified: a recipe that holds one carries the contents of
those chunks beside the list.  Two recipes are then equal exactly when the texts
are, whatever identifier function is given.

Equal recipes are grouped with partial aggregation, so a group that holds a third
of all rows reaches its task as one row per input task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import cut, text_or_empty, unused

# shortest and longest chunk; the end of a line or sentence cuts between them
CHUNK = r"(?s).{512,4094}?(?:\n|[.!?]\s)|.{1,4096}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    identifier: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.

    Defined cases: a null text is empty, and empty texts are equal; a null id is
    smaller than every other; of repeated rows with one id, one is kept; an empty
    table gives no rows; other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    chunk = F.col("chunk")

    # chunks to verified identifiers: the same identifier with two contents is a clash
    contents = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    contents = contents.select(identifier(chunk).alias("ident"), "chunk").distinct()
    clashes = cut(
        contents.groupBy("ident").agg(F.count("*").alias("contents")).where("contents > 1").select("ident"), "clashes"
    )

    # ordered identifier lists; of an identifier that clashes, the content stands beside it
    tagged = texts.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id",
        "row",
        F.sha2("text", 256).alias("text_sha256"),
        F.posexplode_outer(chunks_of(F.col("text"))).alias("pos", "chunk"),
    )
    step = F.struct("pos", F.col("i").alias("ident"), F.when(F.col("ident").isNotNull(), chunk).alias("content"))
    recipes = (
        tagged.withColumn("i", identifier(chunk))
        .join(clashes, F.col("i") == F.col("ident"), "left")
        .groupBy("row", "doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
        .select(
            "doc_id",
            "row",
            "text_sha256",
            F.transform("steps", lambda x: x.ident).alias("idents"),
            F.filter(F.transform("steps", lambda x: x.content), lambda x: x.isNotNull()).alias("contents"),
        )
    )
    return _groups(cut(recipes, "recipes"))


def _groups(recipes: DataFrame) -> DataFrame:
    """Compare the ordered lists; the largest (doc_id, row) of equal ones stays."""
    key = ["idents", "contents"]
    last = F.max(F.struct(F.col("doc_id"), F.col("row")))
    # written first: the join below then has two plain exchanges, so Spark can split a hot recipe
    groups = cut(recipes.groupBy(*key).agg(last.alias("last"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, key).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Every distinct text keeps exactly one row, also where rows repeat whole.
    """
    sha, kept_id, kept_sha = (unused(docs, x) for x in ("_sha", "_kept_id", "_kept_sha"))
    kept = exact_duplicates(docs, id_col=id_col, text_col=text_col).where("kept")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    rows = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256)).join(
        kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi"
    )
    return rows.dropDuplicates([id_col, sha]).select(*docs.columns)
