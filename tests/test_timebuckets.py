"""Week numbering against an independent Python computation over 33 years."""

import datetime as dt

from pyspark.sql import functions as F

from sessionscope.functions.timebuckets import week_sunday0, weekday_mon0, yearweek_sunday


def _yearweek(d: dt.date) -> int:
    sunday = d - dt.timedelta(days=(d.weekday() + 1) % 7)
    return sunday.year * 100 + int(sunday.strftime("%U"))


def test_week_functions_33_years(spark):
    start = dt.date(1999, 1, 1)
    n = (dt.date(2031, 12, 31) - start).days + 1
    days = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    days = days.select("d", F.col("d").cast("timestamp_ntz").alias("t"))
    got = days.select(
        "d",
        week_sunday0("t").alias("w0"),
        week_sunday0(F.col("t")).alias("w0c"),
        yearweek_sunday("t").alias("yw"),
        yearweek_sunday(F.col("t")).alias("ywc"),
        weekday_mon0("t").alias("wd"),
    ).collect()
    assert len(got) == n
    for r in got:
        d = r["d"]
        assert r["w0"] == r["w0c"] == int(d.strftime("%U")), d
        assert r["yw"] == r["ywc"] == _yearweek(d), d
        assert r["wd"] == d.weekday(), d


def test_new_year_examples(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2012, 12, 30, 10),), (dt.datetime(2013, 1, 1, 0),), (dt.datetime(2013, 1, 6, 1),), (dt.datetime(2012, 8, 22),)],
        "t timestamp_ntz",
    )
    got = [tuple(r) for r in df.select(week_sunday0("t"), yearweek_sunday("t")).collect()]
    assert got == [(53, 201253), (0, 201253), (1, 201301), (34, 201234)]
