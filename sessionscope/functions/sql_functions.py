"""Calendar functions of the scripts' SQL dialect, for ``spark.sql``.

Spark SQL has ``YEAR``, ``MONTH``, ``HOUR``, ``DATE`` and ``WEEKDAY`` (Monday =
0), but no ``WEEK`` or ``YEARWEEK``.  ``register_sql_functions`` defines them
as SQL functions (session-scoped, ``CREATE TEMPORARY FUNCTION … RETURN
<expr>``).  Catalyst inlines their bodies, so they run inside whole-stage
codegen like any built-in and constant-fold on literals.  Only mode 0 (weeks
start on Sunday) is supported; another mode raises an error.

With the shop tables registered as views (``ShopTables.register_views``),
SQL written for the original scripts runs as is, given these differences:
ANSI division raises on a zero divisor (write ``NULLIF`` or use
``try_divide``), and ``/`` returns DOUBLE where the original dialect returns
DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sessionscope.functions.timebuckets import WEEK_SQL, YEARWEEK_SQL


def _mode0(body: str) -> str:
    return f"CASE WHEN mode = 0 THEN {body} ELSE raise_error('only week mode 0 (Sunday start) is supported') END"


SQL_FUNCTIONS = {
    "week": f"(d TIMESTAMP_NTZ, mode INT DEFAULT 0) RETURNS INT RETURN {_mode0(WEEK_SQL.format(d='d'))}",
    "yearweek": f"(d TIMESTAMP_NTZ, mode INT DEFAULT 0) RETURNS INT RETURN {_mode0(YEARWEEK_SQL.format(d='d'))}",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define WEEK(d[, 0]) and YEARWEEK(d[, 0]) for this session's SQL."""
    for name, signature in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature}")
    return list(SQL_FUNCTIONS)
