"""Calendar buckets and time windows as plain Column expressions (no UDF).

Week numbering follows the scripts' dialect:

* ``week_sunday0``    WEEK(d) in mode 0: weeks start on Sunday, 0 … 53, week 0
                      holds the days before the year's first Sunday.  Used
                      together with ``YEAR(d)``, so a week that spans New Year
                      is split in two groups.
* ``yearweek_sunday`` YEARWEEK(d) / YEARWEEK(d, 0): year * 100 + week of the
                      Sunday that starts d's week; early-January days before the
                      first Sunday belong to the previous year's last week.
* ``weekday_mon0``    WEEKDAY(d): Monday = 0 … Sunday = 6.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionscope.sources.events import sessions_within
from sessionscope.sources.marks import (
    CREATED,
    PARTITION_DATE,
    SESSION_DATE,
    day_partitioned,
    session_day_column,
    slot_unit,
)

TimeBound = str | _dt.datetime | _dt.date | None


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The week formulas as SQL, used by name and by the SQL functions; ``{d}`` is the day.  dayofweek: Sunday = 1 … Saturday = 7
WEEK_SQL = "CAST(floor((dayofyear({d}) + 7 - dayofweek({d})) / 7) AS INT)"
_SUNDAY_SQL = "date_sub(to_date({d}), dayofweek({d}) - 1)"
YEARWEEK_SQL = f"CAST(year({_SUNDAY_SQL}) * 100 + floor((dayofyear({_SUNDAY_SQL}) + 6) / 7) AS INT)"


def _int_div(numerator: Column, divisor: int) -> Column:
    # operands are small positive ints (day numbers), so floor of the double is exact
    return F.floor(numerator / F.lit(divisor)).cast("int")


def week_sunday0(ts: str | Column) -> Column:
    if isinstance(ts, str):
        return F.expr(WEEK_SQL.format(d=ts))
    return _int_div(F.dayofyear(ts) + 7 - F.dayofweek(ts), 7)


def yearweek_sunday(ts: str | Column) -> Column:
    if isinstance(ts, str):
        return F.expr(YEARWEEK_SQL.format(d=ts))
    sunday = F.date_sub(F.to_date(ts), F.dayofweek(ts) - 1)
    # the week of a Sunday is the same number from either formula
    return (F.year(sunday) * 100 + week_sunday0(sunday)).cast("int")


def weekday_mon0(ts: str | Column) -> Column:
    return F.weekday(_col(ts))


def _ts_text(bound: TimeBound) -> str:
    if isinstance(bound, _dt.datetime):
        return bound.isoformat(sep=" ")
    if isinstance(bound, _dt.date):
        return bound.isoformat()
    return str(bound)


def ts_literal_sql(bound: TimeBound) -> str:
    text = _ts_text(bound)
    if "'" in text or "\\" in text:
        raise ValueError(f"not a time: {text!r}")
    return f"CAST('{text}' AS TIMESTAMP_NTZ)"


def ts_literal(bound: TimeBound) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone.

    A date or 'YYYY-MM-DD' string means midnight, as a date string compared to
    a datetime does in the scripts.
    """
    return F.lit(_ts_text(bound)).cast("timestamp_ntz")


def time_window_sql(
    ts: str,
    start: TimeBound = None,
    end: TimeBound = None,
    *,
    start_exclusive: bool = False,
    end_inclusive: bool = False,
) -> str:
    parts = []
    if start is not None:
        parts.append(f"{ts} {'>' if start_exclusive else '>='} {ts_literal_sql(start)}")
    if end is not None:
        parts.append(f"{ts} {'<=' if end_inclusive else '<'} {ts_literal_sql(end)}")
    return " AND ".join(parts) or "TRUE"


def partition_window_sql(start: TimeBound = None, end: TimeBound = None, column: str = PARTITION_DATE) -> str:
    """Day-partition predicate implied by a ``created_at`` window.

    It keeps every day that can hold a row of the window (a superset), so Spark
    prunes whole directories without changing results.
    """
    parts = []
    if start is not None:
        parts.append(f"{column} >= to_date({ts_literal_sql(start)})")
    if end is not None:
        parts.append(f"{column} <= to_date({ts_literal_sql(end)})")
    return " AND ".join(parts) or "TRUE"


def of_session_days(pageviews, sessions, start: TimeBound = None, end: TimeBound = None):
    """The pageviews of the sessions created on the window's days, whenever the views happened.

    ``None`` where nothing tells the day of a pageview's session in ``sessions``.  On a
    stored layout the predicate is one on its ``session_date`` partitions, so the scan
    skips the days of other sessions; a NULL day (a session unknown when the rows were
    written, or one with rows of several days) is always read.  Where sessions are days
    by derivation it reaches the scan of the events.
    """
    column = session_day_column(pageviews, sessions)
    if column is None or (start is None and end is None):
        return pageviews if column else None
    if column == SESSION_DATE:
        return pageviews.filter(f"{SESSION_DATE} IS NULL OR ({partition_window_sql(start, end, SESSION_DATE)})")
    parts = []
    if start is not None:
        parts.append(f"{CREATED} >= CAST(to_date({ts_literal_sql(start)}) AS TIMESTAMP_NTZ)")
    if end is not None:
        parts.append(f"{CREATED} < CAST(date_add(to_date({ts_literal_sql(end)}), 1) AS TIMESTAMP_NTZ)")
    return pageviews.filter(" AND ".join(parts))


def _check_slots(df, *bounds: TimeBound) -> None:
    """Stored sets answer windows that begin and end with a slot."""
    unit = slot_unit(df)
    if unit is None:
        return
    for bound in bounds:
        at = None if bound is None else _dt.datetime.fromisoformat(_ts_text(bound))
        if at is not None and at != at.replace(minute=0, second=0, microsecond=0, hour=at.hour if unit == "hour" else 0):
            raise ValueError(f"sets by {unit} cannot be cut at {at}")


def within(
    df,
    start: TimeBound = None,
    end: TimeBound = None,
    *,
    start_exclusive: bool = False,
    end_inclusive: bool = False,
    extra_sql: str | None = None,
):
    """``df`` filtered to ``created_at`` in the window (and ``extra_sql``).

    On a table marked as day-partitioned the implied partition predicate is added,
    so the scan skips whole days; sessions derived from events take the bounds
    into the scan of the events.
    """
    pred = time_window_sql(
        "created_at", start, end, start_exclusive=start_exclusive, end_inclusive=end_inclusive
    )
    if extra_sql:
        pred = f"({extra_sql}) AND {pred}"
    if start is not None or end is not None:
        _check_slots(df, start, end)
        df = sessions_within(
            df,
            None if start is None else f"ts >= CAST(to_date({ts_literal_sql(start)}) AS TIMESTAMP_NTZ)",
            None if end is None else f"ts {'<=' if end_inclusive else '<'} {ts_literal_sql(end)}",
        )
        if day_partitioned(df):
            pred = f"{pred} AND {partition_window_sql(start, end)}"
    return df.filter(pred)


def time_window(
    ts: str | Column,
    start: TimeBound = None,
    end: TimeBound = None,
    *,
    start_exclusive: bool = False,
    end_inclusive: bool = False,
) -> Column:
    """Predicate ``start (<|<=) ts (<|<=) end``; a missing bound is open.

    Defaults give the half-open ``[start, end)`` that ``ts >= a AND ts < b``
    writes.  ``end_inclusive`` reproduces ``<= 'YYYY-MM-DD'`` and BETWEEN,
    which keep only the first instant (midnight) of the end day.  The literals
    are constant-folded and pushed into the Parquet scan.
    """
    if isinstance(ts, str):
        return F.expr(
            time_window_sql(
                ts, start, end, start_exclusive=start_exclusive, end_inclusive=end_inclusive
            )
        )
    t = _col(ts)
    pred = F.lit(True)
    if start is not None:
        lo = ts_literal(start)
        pred = pred & ((t > lo) if start_exclusive else (t >= lo))
    if end is not None:
        hi = ts_literal(end)
        pred = pred & ((t <= hi) if end_inclusive else (t < hi))
    return pred
