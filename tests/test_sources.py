"""The derived shop tables have the fixture's documented shape."""

import uuid

import pytest

from pyspark.sql import functions as F

from sessionscope.sources.schemas import ORDERS_SCHEMA, PAGEVIEWS_SCHEMA, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables
from tests.conftest import DATA_ORACLE, DATA_SMALL
from tests.helpers import shop


@pytest.mark.parametrize(
    "data_dir,sessions,pageviews,orders,one_pv",
    [(DATA_SMALL, 397, 1000, 202, 99), (DATA_ORACLE, 4006, 10000, 1981, 1109)],
)
def test_fixture_counts(spark, data_dir, sessions, pageviews, orders, one_pv):
    t = ShopTables.from_events(spark, data_dir)
    assert t.sessions.count() == sessions
    assert t.pageviews.count() == pageviews
    assert t.orders.count() == orders
    per_session = t.pageviews.groupBy("website_session_id").count()
    assert per_session.filter("count = 1").count() == one_pv


def test_schemas(spark):
    t = ShopTables.from_events(spark, DATA_SMALL)
    for df, schema in [(t.sessions, SESSIONS_SCHEMA), (t.pageviews, PAGEVIEWS_SCHEMA), (t.orders, ORDERS_SCHEMA)]:
        assert [f.name for f in df.schema.fields] == [f.name for f in schema.fields]
        assert [f.dataType for f in df.schema.fields] == [f.dataType for f in schema.fields]


def test_keys_valid(spark):
    t = ShopTables.from_events(spark, DATA_ORACLE)
    assert all(t.validate_keys().values())


def test_channel_mix_of_fixture(spark):
    # FIXTURES: gsearch/nonbrand 1627, bsearch/nonbrand 793, gsearch/brand 408,
    # socialbook/pilot 400, organic 393, direct 385 sessions at sf0.01
    t = ShopTables.from_events(spark, DATA_ORACLE)
    got = {
        (r["utm_source"], r["utm_campaign"], r["http_referer"] is None): r["count"]
        for r in t.sessions.groupBy("utm_source", "utm_campaign", F.col("http_referer").isNull().alias("x"))
        .count()
        .withColumnRenamed("x", "http_referer")
        .selectExpr("utm_source", "utm_campaign", "CASE WHEN http_referer THEN NULL ELSE 1 END AS http_referer", "count")
        .collect()
    }
    assert got[("gsearch", "nonbrand", False)] == 1627
    assert got[("bsearch", "nonbrand", False)] == 793
    assert got[("gsearch", "brand", False)] == 408
    assert got[("socialbook", "pilot", False)] == 400
    assert got[(None, None, False)] == 393
    assert got[(None, None, True)] == 385


def test_write_and_read_back(spark, tmp_path):
    t = ShopTables.from_events(spark, DATA_SMALL)
    t.write(str(tmp_path / "shop"))
    back = ShopTables.from_directory(spark, str(tmp_path / "shop"))
    assert back.sessions.count() == 397
    assert back.pageviews.count() == 1000
    assert back.orders.count() == 202


def test_materialize_in_checkpoint_folder(spark):
    t = ShopTables.from_events(spark, DATA_SMALL)
    a, b = t.materialize(spark), t.materialize(spark)  # a folder each
    assert a.sessions.count() == b.sessions.count() == 397
    assert "created_date" in a.pageviews.columns
    name = f"test-materialize-{uuid.uuid4().hex}"
    t.materialize(spark, name=name)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        t.materialize(spark, name=name)


def test_a_hot_session_day_is_written_by_several_tasks(spark, tmp_path):
    rows = [(i, "2024-01-05 10:00:00", 77, "/home") for i in range(20_000)]
    hot = shop(spark, sessions=[(77, "2024-01-05 10:00:00", None, None, "desktop", None)], pageviews=rows)
    confs = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        hot.write(str(tmp_path / "shop"))
        hot.save_as_tables("hot_shop", buckets=4, mode="overwrite")
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert len(list((tmp_path / "shop" / "website_pageviews").rglob("part-*.parquet"))) > 1
    location = spark.sql("DESCRIBE TABLE EXTENDED hot_shop.website_pageviews").filter("col_name = 'Location'").first()["data_type"]
    assert len({r[0] for r in spark.read.parquet(location).select(F.input_file_name()).distinct().collect()}) > 1
    assert ShopTables.from_tables(spark, "hot_shop").pageviews.count() == 20_000


def test_validate_keys_detects_violations(spark):
    dup = shop(
        spark,
        sessions=[(1, "2024-01-01 00:00:00", None, None, "desktop", None)] * 2,
        pageviews=[(5, "2024-01-01 00:00:00", 1, "/home"), (5, "2024-01-01 00:01:00", 1, "/home")],
        orders=[(9, "2024-01-01 00:02:00", 1)],
    )
    assert dup.validate_keys() == {
        "sessions.website_session_id": False,
        "pageviews.website_pageview_id": False,
        "orders.order_id": True,
    }


@pytest.mark.parametrize("fmt,options", [("orc", {}), ("csv", {"header": "true"}), ("json", {})])
def test_load_other_formats(spark, tmp_path, fmt, options):
    from sessionscope import operators as ops
    from tests.helpers import rows

    t = ShopTables.from_events(spark, DATA_SMALL)
    paths = {}
    for name, df in t.named().items():
        paths[name] = str(tmp_path / fmt / name)
        writer = df.write.format(fmt)
        for k, v in options.items():
            writer = writer.option(k, v)
        writer.save(paths[name])
    back = ShopTables.load(spark, paths, format=fmt, options=options)
    kw = dict(start="2024-01-05", end="2024-01-25")
    assert rows(ops.funnel_counts(back.sessions, back.pageviews, **kw)) == rows(
        ops.funnel_counts(t.sessions, t.pageviews, **kw)
    )
    assert rows(ops.conversion_by_device(back.sessions, back.orders, end="2024-01-20")) == rows(
        ops.conversion_by_device(t.sessions, t.orders, end="2024-01-20")
    )
