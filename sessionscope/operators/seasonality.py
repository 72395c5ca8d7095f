"""Seasonality: weekly volume and the hour × weekday profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.metrics import conversion_counts, distinct_counts
from sessionscope.functions.timebuckets import TimeBound, week_sunday0, weekday_mon0, within

# Fixed output names, Monday = 0 … Sunday = 6.
WEEKDAY_COLUMNS = ["mon", "tues", "wed", "thurs", "fri", "sat", "sun"]


def weekly_sessions_orders(
    sessions: DataFrame, orders: DataFrame, *, end: TimeBound = "2013-01-01"
) -> DataFrame:
    """Sessions and orders per YEAR/WEEK (Sunday weeks).

    Out: yr, wk, week_start, sessions, orders.
    """
    return conversion_counts(
        within(sessions, end=end),
        orders,
        [F.year("created_at").alias("yr"), week_sunday0("created_at").alias("wk")],
        first={"week_start": F.to_date("created_at")},
    ).orderBy("yr", "wk")


def hourly_weekday_profile(
    sessions: DataFrame,
    *,
    start: TimeBound = "2012-09-15",
    end: TimeBound = "2012-11-15",
) -> DataFrame:
    """Average sessions per hour of day, overall and per weekday.

    ``created_at BETWEEN start AND end`` (both ends closed).  Averages run over
    the (date, hour) cells that have sessions; an empty cell is not a zero.
    Out: hr, avg_sessions (1 decimal), mon, tues, wed, thurs, fri, sat, sun.
    """
    cells = distinct_counts(
        within(sessions, start, end, end_inclusive=True),
        [
            F.to_date("created_at").alias("day"),
            weekday_mon0("created_at").alias("wkday"),
            F.hour("created_at").alias("hr"),
        ],
        total="website_sessions",
    )
    per_day = [
        F.expr(f"avg(CASE WHEN wkday = {k} THEN website_sessions END)").alias(name)
        for k, name in enumerate(WEEKDAY_COLUMNS)
    ]
    return (
        cells.groupBy("hr")
        .agg(F.round(F.avg("website_sessions"), 1).alias("avg_sessions"), *per_day)
        .orderBy("hr")
    )
