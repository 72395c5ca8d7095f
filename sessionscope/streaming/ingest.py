"""Incremental upkeep of the shop tables from an event stream.

The batch operators read ``website_sessions``, ``website_pageviews`` and
``shop_orders``.  When events arrive continuously, one streaming query keeps
those tables current in the day-partitioned Parquet layout that
:meth:`ShopTables.from_directory` reads.  For each micro-batch,

* pageviews and orders are row-level projections of the events, written to a
  folder that bears the writer's id and the batch's number, which a repeated batch
  overwrites;
* the sessions of the days that the batch touches are derived again from all
  pageviews of those days, and these days' partitions are replaced.

A session is one user on one calendar day, so it depends on its day's pageviews
only, and no event comes too late: a late one is in all three tables after its
batch, as if it had come in time.  No watermark drops anything and no state grows.

The query's checkpoint (offsets) lies beside the tables, so every target has its
own, and a restarted query resumes without loss or duplicates.  The writer is the
streaming query's id, which its checkpoint keeps.  A target belongs to one writer: a
query with another checkpoint would number its batches from 0 again and overwrite
the first one's, so it is refused, as is a target that was written otherwise.
"""

from __future__ import annotations

import os
from concurrent.futures import Future
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionscope.sources.events import (
    orders_from_events,
    pageviews_from_events,
    session_attributes_sql,
)
from sessionscope.sources.marks import PARTITION_DATE, SESSION_DATE
from sessionscope.sources.schemas import EVENTS_SCHEMA, SESSION_ID
from sessionscope.sources.tables import ShopTables, layout_tokens, write_layout


def event_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files landing under ``source`` as a stream with the events schema."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source)


def sessions_from_pageviews(pageviews: DataFrame) -> DataFrame:
    """The sessions of pageviews that hold whole days."""
    known = pageviews.where(f"{SESSION_ID} IS NOT NULL")
    per_session = known.groupBy(SESSION_ID).agg(F.min("created_at").alias("created_at"))
    return per_session.selectExpr(*session_attributes_sql())


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION_DATE, F.to_date("created_at"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(EVENTS_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _claim(spark: SparkSession, root: str, writer: str) -> list[str]:
    """The target's layout tokens: ``writer``'s alone, set by its first batch."""
    own = [f"ingest-{writer}"]
    known = layout_tokens(spark, root)
    if not known:
        if _exists(spark, os.path.join(root, "website_pageviews")):
            raise ValueError(f"{root} holds tables of an unknown writer")
        write_layout(spark, root, own, "errorifexists")
    elif known != own:
        raise ValueError(f"{root} was written by {', '.join(known)}; {own[0]} needs a target of its own")
    return own


def append_events(events: DataFrame, batch_id: int, root: str, writer: str = "manual") -> None:
    """Bring the three tables under ``root`` up to date with one batch of events."""
    spark = events.sparkSession
    tokens = _claim(spark, root, writer)
    for name, rows in (
        # a session is one calendar day, so a pageview's day is its session's
        ("website_pageviews", pageviews_from_events(events).withColumn(SESSION_DATE, F.to_date("created_at"))),
        ("shop_orders", orders_from_events(events)),
    ):
        folder = os.path.join(root, name, f"batch={writer}-{batch_id}")
        days = [c for c in (SESSION_DATE, PARTITION_DATE) if c in (*rows.columns, PARTITION_DATE)]
        _by_day(rows).write.mode("overwrite").partitionBy(*days).parquet(folder)
    days = [r[0] for r in events.select(F.to_date("ts")).where("ts IS NOT NULL").distinct().collect()]
    if not days:
        return
    touched = ShopTables.read_table(spark, root, "website_pageviews", tokens).where(F.col(PARTITION_DATE).isin(days))
    (
        _by_day(sessions_from_pageviews(touched))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION_DATE)
        .parquet(os.path.join(root, "website_sessions"))
    )


@dataclass
class ShopIngest:
    query: StreamingQuery

    def process_all_available(self) -> None:
        self.query.processAllAvailable()

    def stop(self) -> None:
        self.query.stop()


def start_shop_ingest(
    spark: SparkSession,
    source: str,
    target_root: str,
    *,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_files_per_trigger: int | None = None,
) -> ShopIngest:
    """Start the streaming query; returns a handle to wait on or stop."""
    events = event_stream(spark, source, max_files_per_trigger)
    writer: Future[str] = Future()  # known once the query runs; its first batch waits for it
    query = (
        events.writeStream.foreachBatch(
            lambda batch, batch_id: append_events(batch, batch_id, target_root, writer.result(60))
        )
        .option("checkpointLocation", checkpoint or os.path.join(target_root, "_ingest"))
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
    writer.set_result(str(query.id))
    return ShopIngest(query)
