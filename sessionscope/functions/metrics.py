"""Aggregate helpers shared by the operators.

Distinct counts of a key run in two levels: one row per (group, key), then a
count of these rows.  Both levels combine map-side, a hot key or group reaches
its task as one row per input task, and no ``Expand`` is needed.  Where the rows
are hash-partitioned by the key already, the first level adds no shuffle.
Repeated rows of a key count once, as ``COUNT(DISTINCT key)`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.sources.schemas import ORDER_ID, SESSION_ID


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator as DOUBLE; NULL when the denominator is 0 or NULL."""
    if isinstance(numerator, str) and isinstance(denominator, str):
        return F.expr(f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))")
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


# columns of stored sets of sessions and orders (sessionscope.rollups)
SET_BUCKET, SESSION_BITS, ORDER_BITS = "_set_bucket", "_session_bits", "_order_bits"


def holds_sets(df: DataFrame) -> bool:
    """Whether rows are stored sets of sessions instead of sessions."""
    return {SET_BUCKET, SESSION_BITS, ORDER_BITS} <= set(df.columns)


def _set_counts(
    sets: DataFrame, groups: list[Column], bits: dict[str, Column], first: dict[str, Column] | None = None
) -> DataFrame:
    """Per group: the minima ``first`` and the size of the union of each of ``bits``.

    Sets with the same bucket are joined by OR, buckets are disjoint and add up.
    """
    first = first or {}
    rows = sets.select(
        *groups, F.col(SET_BUCKET), *[e.alias(f"_first_{n}") for n, e in first.items()], *[b.alias(f"_bits_{n}") for n, b in bits.items()]
    )
    names = rows.columns[: len(groups)]
    merged = rows.groupBy(*names, SET_BUCKET).agg(
        *[F.min(f"_first_{n}").alias(f"_first_{n}") for n in first],
        *[F.bitmap_or_agg(f"_bits_{n}").alias(f"_bits_{n}") for n in bits],
    )
    return merged.groupBy(*names).agg(
        *[F.min(f"_first_{n}").alias(n) for n in first],
        *[F.coalesce(F.sum(F.bitmap_count(f"_bits_{n}")), F.lit(0).cast("long")).alias(n) for n in bits],
    )


def distinct_counts(
    df: DataFrame,
    groups: list[Column],
    *,
    total: str | None = None,
    when: dict[str, str] | None = None,
    first: dict[str, Column] | None = None,
    key: str = SESSION_ID,
) -> DataFrame:
    """Per group: distinct ``key`` values, and those with a row where a condition holds.

    Out: the groups, the minima named in ``first``, ``total``, one column for each
    condition (SQL text) of ``when``.  Stored sets of sessions are joined and counted.
    """
    when, first = when or {}, first or {}
    if key == SESSION_ID and holds_sets(df):
        bits = {total: F.col(SESSION_BITS)} if total else {}
        bits |= {n: F.expr(f"CASE WHEN {c} THEN {SESSION_BITS} END") for n, c in when.items()}
        return _set_counts(df, groups, bits, first)
    rows = df.select(
        *groups,
        F.col(key).alias("_key"),
        *[e.alias(f"_first_{n}") for n, e in first.items()],
        *[F.expr(f"CASE WHEN {c} THEN 1 END").alias(f"_when_{n}") for n, c in when.items()],
    )
    names = rows.columns[: len(groups)]
    merged = [F.min(f"_first_{n}").alias(f"_first_{n}") for n in first]
    merged += [F.max(f"_when_{n}").alias(f"_when_{n}") for n in when]
    keyed = rows.groupBy(*names, "_key").agg(*merged) if merged else rows.distinct()
    return keyed.groupBy(*names).agg(
        *[F.min(f"_first_{n}").alias(n) for n in first],
        *([F.count("_key").alias(total)] if total else []),
        *[F.expr(f"count(CASE WHEN _when_{n} = 1 THEN _key END)").alias(n) for n in when],
    )


def flag(cond: Column) -> Column:
    """0/1 integer flag (CASE WHEN cond THEN 1 ELSE 0 END)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def orders_per_session(orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct orders (``n_orders``) of each of the given sessions that has any.

    Orders of other sessions are left out before the first shuffle.
    """
    own = orders.select(SESSION_ID, ORDER_ID).join(sessions.select(SESSION_ID), SESSION_ID, "left_semi")
    return own.distinct().groupBy(SESSION_ID).agg(F.count(ORDER_ID).alias("n_orders"))


def with_order_counts(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions with ``n_orders`` attached (NULL when the session has none)."""
    return sessions.join(orders_per_session(orders, sessions), SESSION_ID, "left")


def conversion_counts(
    cohort: DataFrame,
    orders: DataFrame | None,
    groups: list[Column],
    *,
    sessions: str = "sessions",
    total: str = "orders",
    first: dict[str, Column] | None = None,
) -> DataFrame:
    """Per group: the minima ``first``, distinct sessions of the cohort and their distinct orders.

    Stored sets hold the orders beside the sessions; ``orders`` is not read then.
    Out: the groups, the minima, ``sessions``, ``total``.
    """
    first = first or {}
    if holds_sets(cohort):
        return _set_counts(cohort, groups, {sessions: F.col(SESSION_BITS), total: F.col(ORDER_BITS)}, first)
    rows = cohort.select(*groups, F.col(SESSION_ID), *[e.alias(n) for n, e in first.items()])
    names = rows.columns[: len(groups)]
    keyed = rows.groupBy(*names, SESSION_ID).agg(*[F.min(n).alias(n) for n in first]) if first else rows.distinct()
    return with_order_counts(keyed, orders).groupBy(*names).agg(
        *[F.min(n).alias(n) for n in first], F.count(SESSION_ID).alias(sessions), order_total().alias(total)
    )


def order_total(n_orders: str = "n_orders") -> Column:
    """Distinct orders over the grouped sessions (an order belongs to one session)."""
    return F.expr(f"coalesce(sum({n_orders}), CAST(0 AS BIGINT))")
