"""Exact distinct counts from stored sets of sessions and orders.

Every session and every order gets a dense number once.  For each slot of time (a day,
or an hour) and each combination of the session attributes, the numbers are stored as
bitmaps of 32,768 bits.  A set of a longer time, or of fewer attributes, is the OR of
the stored ones, so a session that stands in several slots, or in rows that were loaded
twice, still counts once; nothing is estimated.

:func:`read_session_sets` returns a frame that takes the place of the sessions (and of
the orders) in the operators that count them: traffic, seasonality and channel.  A row
stands for all sessions of its slot; its ``created_at`` is the slot's first instant for
sessions created just then, else the slot's middle, so windows that begin and end with
a slot, open or closed, select exactly the sessions that they select among the rows.

Upkeep: :func:`update_session_sets` numbers the sessions and orders it has not met
behind the others and writes the touched days anew; no other day is read or written.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.metrics import ORDER_BITS, SESSION_BITS, SET_BUCKET
from sessionscope.plans.joins import hot_key_left_join
from sessionscope.sources.marks import CREATED, PARTITION_DATE, mark_day_partition, mark_slots
from sessionscope.sources.schemas import ORDER_ID, SESSION_ID, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables

ATTRIBUTES = [f.name for f in SESSIONS_SCHEMA.fields if f.name not in (SESSION_ID, CREATED)]
UNITS = {"day": "12 HOURS", "hour": "30 MINUTES"}  # a slot's middle, counted from its start
_SETS_SCHEMA = (
    f"{CREATED} timestamp_ntz, " + ", ".join(f"{a} string" for a in ATTRIBUTES)
    + f", {SET_BUCKET} long, {SESSION_BITS} binary, {ORDER_BITS} binary, {PARTITION_DATE} date"
)


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _number(ids: DataFrame, key: str, order: list[str], path: str) -> DataFrame:
    """The dense numbers (from 1) of the ids, after those already stored below ``path``.

    New ids are range-partitioned and sorted; a row's place in its partition is written
    first, so that a repeated task cannot change it, and what lies before a partition is
    a sum over one number for each partition.
    """
    spark = ids.sparkSession
    schema = f"{key} long, n long"
    known = _read_if_there(spark, path, schema)
    last = 0
    if known is not None:
        last = known.agg(F.max("n")).first()[0] or 0
        ids = ids.join(known.select(key), key, "left_anti")
    placed = f"{path}-placed-after-{last}"
    (
        ids.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(key, F.monotonically_increasing_id().alias("at"))
        .write.mode("overwrite")
        .parquet(placed)
    )
    rows = spark.read.schema(f"{key} long, at long").parquet(placed)
    # the id counts from 0 within the partition in its upper bits
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in rows.groupBy(part.alias("part")).count().collect()}
    before, total = [], last
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    bases = F.broadcast(spark.createDataFrame(before, "part long, base long"))  # a row for each partition
    numbered = rows.select(key, part.alias("part"), place.alias("place")).join(bases, "part")
    numbered.select(key, (F.col("base") + F.col("place") + 1).alias("n")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _folder(root: str, unit: str) -> str:
    return os.path.join(root, f"session_sets_by_{unit}")


def _sets(rows: DataFrame, bits: str) -> DataFrame:
    """The numbers ``n`` of each slot and attributes as bitmaps."""
    keys = [PARTITION_DATE, CREATED, *ATTRIBUTES]
    return (
        rows.withColumn(SET_BUCKET, F.bitmap_bucket_number("n"))
        .groupBy(*keys, SET_BUCKET)
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias(bits))
    )


def update_session_sets(shop: ShopTables, root: str, days: Iterable[dt.date] | None, unit: str = "day") -> None:
    """Bring the sets below ``root`` up to date with the sessions of the given days.

    ``days`` are the days on which sessions were added or changed, or on which the
    sessions of added orders began; ``None`` means all.  Only their partitions are
    written.  A day whose sessions are all gone must be removed by the caller.

    Defined cases: sessions without an id count nowhere, as in a distinct count; rows
    that repeat a session or an order count once; an order of an unknown session counts
    nowhere; NULL attributes form sets of their own; empty tables give no sets.
    """
    spark = shop.sessions.sparkSession
    middle = UNITS[unit]
    slot = f"CAST(to_date({CREATED}) AS TIMESTAMP_NTZ)"
    if unit == "hour":
        slot += f" + make_dt_interval(0, hour({CREATED}))"
    sessions = shop.sessions.where(f"{SESSION_ID} IS NOT NULL AND {CREATED} IS NOT NULL")
    sessions = sessions.withColumn(PARTITION_DATE, F.to_date(CREATED))
    if days is not None:
        sessions = sessions.where(F.col(PARTITION_DATE).isin(sorted(set(days))))
    first = sessions.groupBy(SESSION_ID).agg(F.min(CREATED).alias("_first"))
    numbers = _number(first, SESSION_ID, ["_first", SESSION_ID], os.path.join(root, "session_numbers"))
    slots = sessions.select(
        SESSION_ID,
        PARTITION_DATE,
        F.expr(f"CASE WHEN {CREATED} = {slot} THEN {CREATED} ELSE {slot} + INTERVAL {middle} END").alias(CREATED),
        *ATTRIBUTES,
    ).distinct()
    session_sets = _sets(slots.join(numbers, SESSION_ID), SESSION_BITS)

    orders = shop.orders.where(f"{ORDER_ID} IS NOT NULL AND {SESSION_ID} IS NOT NULL").select(ORDER_ID, SESSION_ID)
    if days is not None:
        orders = orders.join(first.select(SESSION_ID), SESSION_ID, "left_semi")
    orders = orders.distinct()
    # a session may hold many orders: only such ones are split
    owned = hot_key_left_join(orders, slots, SESSION_ID, left_id=ORDER_ID, right_id=SESSION_ID).where(
        f"{PARTITION_DATE} IS NOT NULL"
    )
    ids = owned.select(ORDER_ID).distinct()
    order_numbers = _number(ids, ORDER_ID, [ORDER_ID], os.path.join(root, "order_numbers"))
    order_sets = _sets(owned.join(order_numbers, ORDER_ID), ORDER_BITS)
    (
        session_sets.unionByName(order_sets, allowMissingColumns=True)
        .repartitionByRange(PARTITION_DATE, CREATED, SET_BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(PARTITION_DATE)
        .parquet(_folder(root, unit))
    )


def build_session_sets(shop: ShopTables, root: str, unit: str = "day") -> None:
    """Number all sessions and orders and store their sets below ``root``, a new folder."""
    update_session_sets(shop, root, None, unit)


def read_session_sets(spark: SparkSession, root: str, unit: str = "day") -> DataFrame:
    """The stored sets, to be given to operators in place of sessions (and orders).

    A time window that cuts through a slot is refused.
    """
    sets = spark.read.schema(_SETS_SCHEMA).parquet(_folder(root, unit))
    return mark_slots(mark_day_partition(sets, f"sets of {root}"), unit)
