"""What the library knows about the days of the tables that it derived or wrote.

Marks are column metadata.  They follow a column through filters, selections and
semi joins, and vanish where the column is computed anew, so a changed ``created_at``
is never pruned by the day it once had.  A mark is set by what made the rows: the
derivation, or the layout file that ``ShopTables.write`` leaves beside the tables.
Columns that merely have the right name carry none.

Rows that a caller adds by ``union`` to marked tables must obey the same rules;
``unmarked`` takes the marks off.

* day: ``created_date`` is the calendar day of ``created_at``; both columns carry the
  same token.
* slots: ``created_at`` stands for a whole day or hour (:mod:`sessionscope.rollups`).
* sessions / session day: the session table's ``created_at`` carries a token, and so
  does the column that holds the day of the *session* of each pageview: a stored
  ``session_date``, or ``created_at`` itself where sessions are days by derivation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

CREATED = "created_at"
PARTITION_DATE = "created_date"
SESSION_DATE = "session_date"
_DAY, _SESSIONS, _SESSION_DAY = "sessionscope.day", "sessionscope.sessions", "sessionscope.session_day"
_SLOTS = "sessionscope.slots"


def _put(df: DataFrame, column: str, **marks: str) -> DataFrame:
    known = df.schema[column].metadata
    return df.withMetadata(column, {**known, **marks})


def _get(df: DataFrame, column: str, mark: str) -> str | None:
    found = [f.metadata.get(mark) for f in df.schema.fields if f.name == column]
    return found[0] if found else None


def mark_day_partition(df: DataFrame, token: str) -> DataFrame:
    """Say that ``created_date`` is the calendar day of ``created_at``."""
    return _put(_put(df, PARTITION_DATE, **{_DAY: token}), CREATED, **{_DAY: token})


def mark_sessions(sessions: DataFrame, token: str) -> DataFrame:
    """Name the session table whose days the pageviews marked with ``token`` hold."""
    return _put(sessions, CREATED, **{_SESSIONS: token})


def mark_session_day(pageviews: DataFrame, token: str, column: str = SESSION_DATE) -> DataFrame:
    """Say that ``column`` tells the day of the pageview's session in the table of ``token``."""
    return _put(pageviews, column, **{_SESSION_DAY: token})


def mark_slots(sets: DataFrame, unit: str) -> DataFrame:
    """Say that ``created_at`` stands for a whole ``day`` or ``hour``."""
    return _put(sets, CREATED, **{_SLOTS: unit})


def slot_unit(df: DataFrame) -> str | None:
    return _get(df, CREATED, _SLOTS)


def unmarked(df: DataFrame) -> DataFrame:
    """The same rows, of which nothing is known."""
    for column in (CREATED, PARTITION_DATE, SESSION_DATE):
        if column in df.columns:
            rest = {k: v for k, v in df.schema[column].metadata.items() if k not in (_DAY, _SESSIONS, _SESSION_DAY)}
            df = df.withMetadata(column, rest)
    return df


def day_partitioned(df: DataFrame) -> bool:
    token = _get(df, CREATED, _DAY)
    return token is not None and token == _get(df, PARTITION_DATE, _DAY)


def session_day_column(pageviews: DataFrame, sessions: DataFrame) -> str | None:
    """The column of ``pageviews`` that tells the day of their session in ``sessions``."""
    token = _get(sessions, CREATED, _SESSIONS)
    if token is None:
        return None
    return next((c for c in (SESSION_DATE, CREATED) if _get(pageviews, c, _SESSION_DAY) == token), None)
