"""Column-level helpers: calendar buckets, time windows, ratios, key counts."""

from sessionscope.functions.metrics import (
    distinct_counts,
    flag,
    order_total,
    orders_per_session,
    ratio,
    with_order_counts,
)
from sessionscope.functions.sql_functions import register_sql_functions
from sessionscope.functions.timebuckets import (
    time_window,
    ts_literal,
    week_sunday0,
    weekday_mon0,
    within,
    yearweek_sunday,
)

__all__ = [
    "distinct_counts",
    "flag",
    "order_total",
    "orders_per_session",
    "ratio",
    "register_sql_functions",
    "time_window",
    "ts_literal",
    "within",
    "week_sunday0",
    "weekday_mon0",
    "with_order_counts",
    "yearweek_sunday",
]
