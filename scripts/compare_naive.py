"""Time operators against naive DataFrame formulations of the same analyses.

The naive forms are the textbook plans: ``count_distinct`` on every measure
(Spark expands one row copy per distinct expression), joins before
aggregation (session × orders fan-out), and the first pageview found by a
min-id join back to the pageviews.  Equal results are asserted; times are
medians of warm runs.

Usage: python scripts/compare_naive.py [data_dir] [cpus] [runs]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sessionscope import operators as ops  # noqa: E402
from sessionscope.functions.timebuckets import week_sunday0  # noqa: E402
from sessionscope.operators.channel import channel_group  # noqa: E402
from sessionscope.session import build_session  # noqa: E402
from sessionscope.sources.tables import ShopTables  # noqa: E402

SID, PID = "website_session_id", "website_pageview_id"
def paid():
    return (F.col("utm_source") == "gsearch") & (F.col("utm_campaign") == "nonbrand")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def ratio(a, b):
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def cd_when(cond, key=SID):
    return F.count_distinct(F.when(cond, F.col(key)))


def naive_conversion_by_device(t):
    cohort = t.sessions.filter(paid() & (F.col("created_at") < ts("2024-01-20")))
    return (
        cohort.join(t.orders.select(SID, "order_id"), SID, "left")
        .groupBy("device_type")
        .agg(F.count_distinct(SID).alias("sessions"), F.count_distinct("order_id").alias("orders"))
        .withColumn("session_to_order_cvr", ratio("orders", "sessions"))
    )


def naive_weekly_sessions_by_device(t):
    c = t.sessions.filter(paid() & (F.col("created_at") > ts("2024-01-03")) & (F.col("created_at") < ts("2024-01-29")))
    return c.groupBy(F.year("created_at").alias("yr"), week_sunday0("created_at").alias("wk")).agg(
        F.min(F.to_date("created_at")).alias("week_start_date"),
        cd_when(F.col("device_type") == "desktop").alias("desktop_sessions"),
        cd_when(F.col("device_type") == "mobile").alias("mobile_sessions"),
        F.count_distinct(SID).alias("total_sessions"),
    )


def naive_monthly_channel_mix(t):
    c = t.sessions.filter(F.col("created_at") < ts("2024-01-31")).withColumn("g", channel_group())
    m = c.groupBy(F.year("created_at").alias("yr"), F.month("created_at").alias("mo")).agg(
        *[cd_when(F.col("g") == lbl).alias(name) for lbl, name in [
            ("paid_nonbrand", "nonbrand"), ("paid_brand", "brand"),
            ("direct_type_in", "direct"), ("organic_search", "organic")]]
    )
    return m.select(
        "yr", "mo", "nonbrand", "brand", ratio("brand", "nonbrand").alias("brand_pct_of_nonbrand"),
        "direct", ratio("direct", "nonbrand").alias("direct_pct_of_nonbrand"),
        "organic", ratio("organic", "nonbrand").alias("organic_pct_of_nonbrand"),
    )


def naive_bounce_rate_by_landing_page(t):
    pv = t.pageviews
    launch = pv.filter(F.col("pageview_url") == "/lander-1").agg(F.min(PID)).scalar()
    cohort = t.sessions.filter(paid() & (F.col("created_at") < ts("2024-01-28"))).select(SID)
    first = pv.filter(F.col(PID) > launch).join(cohort, SID).groupBy(SID).agg(F.min(PID).alias("m"))
    landed = (
        first.join(pv.select(F.col(PID).alias("m"), F.col("pageview_url").alias("landing_page")), "m")
        .filter(F.col("landing_page").isin("/home", "/lander-1"))
        .select(SID, "landing_page")
    )
    bounced = landed.join(pv.select(SID, PID), SID).groupBy(SID).agg(F.count(PID).alias("n")).filter("n = 1")
    joined = landed.join(bounced.select(F.col(SID).alias("b")), F.col(SID) == F.col("b"), "left")
    return (
        joined.groupBy("landing_page")
        .agg(F.count_distinct(SID).alias("sessions"), F.count_distinct("b").alias("bounced_sessions"))
        .withColumn("bounce_rate", ratio("bounced_sessions", "sessions"))
    )


def naive_funnel_counts(t):
    cohort = t.sessions.filter(
        paid() & (F.col("created_at") > ts("2024-01-05")) & (F.col("created_at") < ts("2024-01-25"))
    ).select(SID)
    rows = cohort.join(t.pageviews.select(SID, "pageview_url"), SID, "left")
    steps = [s.url for s in ops.DEFAULT_STEPS]
    flags = rows.groupBy(SID).agg(
        *[F.max(F.when(F.col("pageview_url") == u, 1).otherwise(0)).alias(f"f{i}") for i, u in enumerate(steps)]
    )
    return flags.agg(
        F.count_distinct(SID).alias("sessions"),
        *[cd_when(F.col(f"f{i}") == 1).alias(s.reached) for i, s in enumerate(ops.DEFAULT_STEPS)],
    )


def naive_variant_conversion(t):
    pv = t.pageviews
    launch = pv.filter(F.col("pageview_url") == "/billing-2").agg(F.min(PID)).scalar()
    views = pv.filter(
        (F.col(PID) >= launch) & (F.col("created_at") < ts("2024-01-28"))
        & F.col("pageview_url").isin("/billing", "/billing-2")
    ).select(SID, F.col("pageview_url").alias("billing_version_seen"))
    return (
        views.join(t.orders.select(SID, "order_id"), SID, "left")
        .groupBy("billing_version_seen")
        .agg(F.count_distinct(SID).alias("sessions"), F.count_distinct("order_id").alias("orders"))
        .withColumn("billing_to_order_rt", ratio("orders", "sessions"))
    )


CASES = {
    "conversion_by_device": (lambda t: ops.conversion_by_device(t.sessions, t.orders, end="2024-01-20"),
                             naive_conversion_by_device),
    "weekly_sessions_by_device": (lambda t: ops.weekly_sessions_by_device(t.sessions, start="2024-01-03", end="2024-01-29"),
                                  naive_weekly_sessions_by_device),
    "monthly_channel_mix": (lambda t: ops.monthly_channel_mix(t.sessions, end="2024-01-31"), naive_monthly_channel_mix),
    "bounce_rate_by_landing_page": (lambda t: ops.bounce_rate_by_landing_page(t.sessions, t.pageviews, end="2024-01-28"),
                                    naive_bounce_rate_by_landing_page),
    "funnel_counts": (lambda t: ops.funnel_counts(t.sessions, t.pageviews, start="2024-01-05", end="2024-01-25"),
                      naive_funnel_counts),
    "variant_conversion": (lambda t: ops.variant_conversion(t.pageviews, t.orders, end="2024-01-28"),
                           naive_variant_conversion),
}


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def main() -> None:
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 4
    runs = int(sys.argv[3]) if len(sys.argv) > 3 else 5
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    for name, (ours, naive) in CASES.items():
        def build(fn):
            return fn(ShopTables.from_events(spark, data_dir))

        assert _rows(build(ours)) == _rows(build(naive)), name
        times = {}
        for label, fn in (("sessionscope", ours), ("naive", naive)):
            for _ in range(2):
                build(fn).write.format("noop").mode("overwrite").save()
            ts_ = []
            for _ in range(runs):
                t0 = time.perf_counter()
                build(fn).write.format("noop").mode("overwrite").save()
                ts_.append(time.perf_counter() - t0)
            times[label] = round(statistics.median(ts_), 3)
        print(json.dumps({name: times}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
