"""Join shapes that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it has more than this share of a side's rows (and more than
# ``task_rows``), so at most 1 / share keys of a side are hot and no hot key is left out.
HOT_SHARE = 1 / 512
# Keys that the sketch follows: its error is below 3.5 / 8192 of the rows, a fifth of the share.
_TRACKED = 8192
# Rows without a key meet nothing; they are only spread.
_NO_KEY_PARTS = 4096


def hot_keys(df: DataFrame, key: str, *, task_rows: int) -> DataFrame:
    """Keys with many rows, and into how many parts of about ``task_rows`` rows they fall.

    A heavy-hitter sketch of the key column: every task keeps a bounded number of
    counters, so the result has at most 512 rows whatever the number of keys.  Its
    counts are estimates; every reported key occurs.

    Out: ``key``, parts.
    """
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {round(1 / HOT_SHARE)}, {_TRACKED})").alias("top"), F.count(key).alias("n")
    )
    limit = f"greatest({int(task_rows)}, n * {HOT_SHARE})"
    return sketch.selectExpr("n", "inline(top) AS (item, rows)").where(f"rows > {limit}").selectExpr(
        f"item AS {key}", f"CAST(ceil(rows / {limit}) AS INT) AS parts"
    )


def _parts(hot: DataFrame, key: str, name: str) -> DataFrame:
    return hot.select(key, F.col("parts").alias(name))


def _part(row_id: Column, parts: str) -> Column:
    """The part of a row among ``parts`` (NULL where its key is not hot: the one part 0)."""
    return F.when(F.col(parts) > 1, F.pmod(F.xxhash64(row_id), F.col(parts)).cast("int")).otherwise(F.lit(0))


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))


def hot_key_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    right_id: str,
    left_id: str | None = None,
    task_rows: int = 1_000_000,
) -> DataFrame:
    """``left ⟕ right`` on ``key`` (any number of rows per key on either side).

    Hot keys are found by a sketch of each side's key column.  The rows of a hot key
    form a grid: its left rows are dealt to a parts and its right rows to b parts by a
    hash of their own ids, and each left part meets each right part in a task of its
    own, so left rows stand b times and right rows a times.  All other keys are one
    cell; none of their rows is copied.  The hot keys (at most 512 of a side) are the
    only thing that is broadcast.

    ``left_id`` names the left side's row id; without it the left side is taken to
    have few rows of a key and is not sketched.  A left row of a key with several right
    parts always has a partner, so its empty cells are dropped; every other left row
    meets all right rows of its key in one cell, where the outer join keeps it.

    Output columns: ``key``, the other ``left`` columns, then the ``right`` columns
    (NULL for left rows without a partner).  ``task_rows`` never changes the rows.
    """
    dealt_left, dealt_right = dealt_sides(left, right, key, right_id=right_id, left_id=left_id, task_rows=task_rows)
    cells = dealt_left.join(dealt_right, [key, "_i", "_j"], "left")
    return cells.where("_met OR NOT _has_partner").select(*left.columns, *[c for c in right.columns if c != key])


def dealt_sides(
    left: DataFrame, right: DataFrame, key: str, *, right_id: str, left_id: str | None, task_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (_i, _j) of every row, rows of hot keys once for each cell."""
    grid = _parts(hot_keys(right, key, task_rows=task_rows), key, "_right_parts")
    if left_id is not None:
        grid = grid.join(_parts(hot_keys(left, key, task_rows=task_rows), key, "_left_parts"), key, "full")
    else:
        grid = grid.withColumn("_left_parts", F.lit(1))
    grid = F.broadcast(grid)
    own = F.col(left_id) if left_id is not None else F.struct(*left.columns)
    dealt_left = left.join(grid, key, "left").select(
        *left.columns,
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(own), F.lit(_NO_KEY_PARTS)).cast("int"))
        .otherwise(_part(own, "_left_parts"))
        .alias("_i"),
        (F.coalesce(F.col("_right_parts"), F.lit(1)) > 1).alias("_has_partner"),
        _every("_right_parts").alias("_j"),
    )
    dealt_right = right.where(F.col(key).isNotNull()).join(grid, key, "left").select(
        *right.columns,
        _part(F.col(right_id), "_right_parts").alias("_j"),
        _every("_left_parts").alias("_i"),
        F.lit(True).alias("_met"),
    )
    return dealt_left, dealt_right
