"""Streaming upkeep of the shop tables equals the batch derivation."""

import datetime as dt
import os
import shutil

import pytest

from sessionscope import operators as ops
from sessionscope.sources.schemas import EVENTS_SCHEMA
from sessionscope.sources.tables import ShopTables
from sessionscope.streaming import append_events, start_shop_ingest
from tests.conftest import DATA_SMALL
from tests.helpers import rows


def ingest(spark, landing, target):
    start_shop_ingest(spark, str(landing), str(target), trigger={"availableNow": True}).query.awaitTermination(300)
    return ShopTables.from_directory(spark, str(target))


def same(streamed, batch):
    for name, df in streamed.named().items():
        assert rows(df.drop("created_date", "session_date")) == rows(batch.named()[name]), name


def test_stream_ingest_matches_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    shutil.copy(os.path.join(DATA_SMALL, "events.parquet"), landing / "part-0.parquet")
    streamed = ingest(spark, landing, tmp_path / "shop")
    batch = ShopTables.from_events(spark, DATA_SMALL)
    same(streamed, batch)
    # operators run unchanged on the streamed, day-partitioned tables
    assert rows(ops.top_pages(streamed.pageviews, end="2024-01-20")) == rows(
        ops.top_pages(batch.pageviews, end="2024-01-20")
    )


def _events(*rows_):
    return [(i, dt.datetime.fromisoformat(t), u, kind, 1.0, None) for i, t, u, kind in rows_]


@pytest.fixture
def batches():
    first = _events((1, "2024-01-05 10:00:00", 1, "view"), (2, "2024-01-06 10:00:00", 2, "view"), (3, "2025-01-05 09:00:00", 1, "view"))
    # days later: an earlier event of a known session, one of a new session, an order
    late = _events((4, "2024-01-05 08:00:00", 1, "view"), (5, "2024-01-05 07:00:00", 3, "click"), (6, "2024-01-05 11:00:00", 1, "purchase"))
    return first, late


def test_late_events_and_two_years(spark, tmp_path, batches):
    landing = tmp_path / "landing"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
        streamed = ingest(spark, landing, tmp_path / "shop")
    batch = ShopTables.from_events_frame(spark.createDataFrame([e for b in batches for e in b], EVENTS_SCHEMA))
    same(streamed, batch)
    # one user on the same day of two years is two sessions, in both paths
    assert batch.sessions.filter("website_session_id div 10000000 = 1").count() == 2
    first = streamed.sessions.orderBy("created_at").collect()
    assert [str(r.created_at) for r in first] == ["2024-01-05 07:00:00", "2024-01-05 08:00:00", "2024-01-06 10:00:00", "2025-01-05 09:00:00"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, batches):
    root = str(tmp_path / "shop")
    for i, batch in enumerate([*batches, batches[1]]):
        append_events(spark.createDataFrame(batch, EVENTS_SCHEMA), min(i, 1), root)
    same(
        ShopTables.from_directory(spark, root),
        ShopTables.from_events_frame(spark.createDataFrame([e for b in batches for e in b], EVENTS_SCHEMA)),
    )
