"""A session holding a third of all pageviews and orders: results stay whole
and equal to plain (non-skew-aware) formulations."""

import pytest
from pyspark.sql import functions as F

from sessionscope import operators as ops
from sessionscope.plans.joins import dealt_sides, hot_key_left_join, hot_keys
from sessionscope.sources.schemas import SESSION_ID
from sessionscope.sources.tables import ShopTables
from tests.conftest import DATA_ORACLE
from tests.helpers import rows

HOT = 7_000_001


@pytest.fixture(scope="module")
def skewed(spark):
    t = ShopTables.from_events(spark, DATA_ORACLE)
    n = t.pageviews.count()
    # move every third pageview / order into one hot session of the same day
    pv = t.pageviews.withColumn(
        SESSION_ID,
        F.when(F.col("website_pageview_id") % 3 == 0, F.lit(HOT)).otherwise(F.col(SESSION_ID)),
    )
    orders = t.orders.withColumn(
        SESSION_ID, F.when(F.col("order_id") % 3 == 0, F.lit(HOT)).otherwise(F.col(SESSION_ID))
    )
    hot_session = t.sessions.limit(1).withColumn(SESSION_ID, F.lit(HOT).cast("long"))
    sessions = t.sessions.unionByName(hot_session)
    assert pv.filter(F.col(SESSION_ID) == HOT).count() >= n // 3 - 1
    return ShopTables(sessions, pv, orders)


def same(a, b):
    assert a.columns == b.columns
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("task_rows", [1, 50, 1_000_000])
def test_hot_key_left_join_equals_left_join(skewed, task_rows):
    left = skewed.sessions.select(SESSION_ID, "device_type")
    right = skewed.pageviews.select(SESSION_ID, "website_pageview_id", "pageview_url")
    a = hot_key_left_join(left, right, SESSION_ID, right_id="website_pageview_id", task_rows=task_rows)
    same(a, left.join(right, SESSION_ID, "left").select(*a.columns))


def test_funnel_counts_match_brute_force(spark, skewed):
    skewed.register_views()
    kw = dict(start="2024-01-01", end="2024-01-31")
    got = rows(ops.funnel_counts(skewed.sessions, skewed.pageviews, **kw))
    seen = ", ".join(
        f"COUNT(DISTINCT s.website_session_id) FILTER (WHERE p.pageview_url = '{st.url}')" for st in ops.DEFAULT_STEPS
    )
    want = rows(spark.sql(f"""
        SELECT COUNT(DISTINCT s.website_session_id), {seen}
        FROM website_sessions s LEFT JOIN website_pageviews p USING (website_session_id)
        WHERE s.utm_source = 'gsearch' AND s.utm_campaign = 'nonbrand'
          AND s.created_at > TIMESTAMP_NTZ '2024-01-01 00:00:00'
          AND s.created_at < TIMESTAMP_NTZ '2024-01-31 00:00:00'
    """))
    assert got == want


def test_variant_conversion_matches_brute_force(spark, skewed):
    skewed.register_views()
    got = rows(ops.variant_conversion(skewed.pageviews, skewed.orders, end="2024-01-28"))
    want = rows(spark.sql("""
        WITH start AS (SELECT MIN(website_pageview_id) AS id FROM website_pageviews WHERE pageview_url = '/billing-2'),
             seen AS (SELECT DISTINCT website_session_id, pageview_url AS v FROM website_pageviews
                      WHERE website_pageview_id >= (SELECT id FROM start)
                        AND created_at < TIMESTAMP_NTZ '2024-01-28 00:00:00'
                        AND pageview_url IN ('/billing', '/billing-2'))
        SELECT v, COUNT(DISTINCT seen.website_session_id), COUNT(DISTINCT o.order_id),
               COUNT(DISTINCT o.order_id) / COUNT(DISTINCT seen.website_session_id)
        FROM seen LEFT JOIN shop_orders o USING (website_session_id)
        GROUP BY v
    """))
    assert got == want


def test_bounce_rate_by_landing_page_matches_brute_force(spark, skewed):
    skewed.register_views()
    got = rows(ops.bounce_rate_by_landing_page(skewed.sessions, skewed.pageviews, end="2024-01-28"))
    want = rows(spark.sql("""
        WITH start AS (SELECT MIN(website_pageview_id) AS id FROM website_pageviews WHERE pageview_url = '/lander-1'),
             cohort AS (SELECT website_session_id FROM website_sessions
                        WHERE created_at < TIMESTAMP_NTZ '2024-01-28 00:00:00'
                          AND utm_source = 'gsearch' AND utm_campaign = 'nonbrand'),
             entry AS (SELECT website_session_id, MIN_BY(pageview_url, website_pageview_id) AS lp
                       FROM website_pageviews
                       WHERE website_pageview_id > (SELECT id FROM start)
                         AND website_session_id IN (SELECT website_session_id FROM cohort)
                       GROUP BY website_session_id),
             views AS (SELECT website_session_id, COUNT(*) AS n FROM website_pageviews GROUP BY website_session_id)
        SELECT lp, COUNT(*), COUNT(*) FILTER (WHERE n = 1), COUNT(*) FILTER (WHERE n = 1) / COUNT(*)
        FROM entry JOIN views USING (website_session_id)
        WHERE lp IN ('/home', '/lander-1')
        GROUP BY lp
    """))
    assert got == want


@pytest.mark.parametrize("task_rows", [1, 50, 1_000_000])
def test_hot_key_left_join_with_many_left_rows_per_key(skewed, task_rows):
    left = skewed.pageviews.filter("pageview_url IN ('/billing', '/billing-2')").select(
        SESSION_ID, "website_pageview_id", "pageview_url"
    )
    right = skewed.orders.select(SESSION_ID, "order_id")
    a = hot_key_left_join(
        left, right, SESSION_ID, left_id="website_pageview_id", right_id="order_id", task_rows=task_rows
    )
    same(a, left.join(right, SESSION_ID, "left").select(*a.columns))


# left and right rows of each key: hot on the left, on the right, on both, on neither, on one side alone
KEYS = {1: (6000, 3), 2: (3, 6000), 3: (300, 300), 4: (2, 2), 5: (5000, 0), 6: (0, 5000), 7: (1, 0), 8: (0, 1), None: (4000, 4000)}


def two_sides(spark):
    def side(n, extra):
        rows = [(i * 1000 + (k or 0), k) for k, sizes in KEYS.items() for i in range(sizes[n])]
        rows += [(10_000_000 + i, 100 + i) for i in range(extra)]
        return spark.createDataFrame(rows, f"{'lr'[n]} long, k long").repartition(6)

    return side(0, 6000), side(1, 4000)


@pytest.mark.parametrize("task_rows", [10, 200, 100_000])
def test_every_kind_of_key(spark, task_rows):
    left, right = two_sides(spark)
    a = hot_key_left_join(left, right, "k", left_id="l", right_id="r", task_rows=task_rows)
    same(a, left.join(right, "k", "left").select("l", "k", "r"))


def test_hot_keys_are_found_and_bounded(spark):
    left, right = two_sides(spark)
    found = {r.k: r.parts for r in hot_keys(left, "k", task_rows=200).collect()}
    # the sketch counts at most a few rows more; rows without a key are no key
    assert set(found) == {1, 3, 5} and 30 <= found[1] <= 34 and 25 <= found[5] <= 28 and found[3] == 2
    assert hot_keys(left, "k", task_rows=100_000).count() == 0
    assert hot_keys(left.limit(0), "k", task_rows=1).count() == 0
    many = spark.range(600 * 40).selectExpr("id % 600 AS k")
    assert hot_keys(many, "k", task_rows=1).count() <= 512


def test_empty_sides(spark):
    left, right = two_sides(spark)
    kw = dict(left_id="l", right_id="r", task_rows=10)
    assert hot_key_left_join(left.limit(0), right, "k", **kw).isEmpty()
    a = hot_key_left_join(left, right.limit(0), "k", **kw)
    assert a.count() == left.count() and a.where("r IS NOT NULL").isEmpty()


@pytest.fixture
def plain_shuffles(spark):
    """64 reducers, no help from adaptive execution or broadcasts of a side."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    for k in confs:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_a_hot_key_of_either_side_is_split(spark, plain_shuffles):
    """Rows of the fullest task where one key holds half of the left, or of the right, side."""
    n = 40_000
    hot = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k", "id AS row")
    few = spark.range(n // 10).selectExpr("id * 2 + 1 AS k", "id AS other").unionByName(
        spark.createDataFrame([(7, -1), (7, -2)], "k long, other long")
    )
    for left, right, ids in ((hot, few, ("row", "other")), (few, hot, ("other", "row"))):
        plain = left.join(right, "k", "left")
        split = hot_key_left_join(left, right, "k", left_id=ids[0], right_id=ids[1], task_rows=500)
        assert plain.count() == split.count()
        assert largest_task(plain) >= n / 2
        assert largest_task(split) < largest_task(plain) / 8


def test_cold_rows_are_not_copied(spark):
    left = spark.range(10_000).selectExpr("id AS k", "id AS l")
    right = spark.range(5_000).selectExpr("CASE WHEN id < 2500 THEN 3 ELSE id END AS k", "id AS r")
    a, b = dealt_sides(left, right, "k", left_id="l", right_id="r", task_rows=250)
    copies = {r.k: r["count"] for r in a.groupBy("k").count().where("count > 1").collect()}
    assert copies == {3: hot_keys(right, "k", task_rows=250).first()["parts"]} and copies[3] >= 10
    assert b.count() == 5_000
