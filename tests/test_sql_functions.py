"""The registered WEEK and YEARWEEK on single dates, with the weeks worked out by hand."""

import pytest

from sessionscope.functions.sql_functions import register_sql_functions
from sessionscope.plans.inspect import plan_summary

# date, WEEK, YEARWEEK, WEEKDAY (Monday = 0): weeks start on Sunday
DATES = [
    ("2011-12-31 12:00:00", 52, 201152, 5),  # Saturday
    ("2012-01-01 00:00:00", 1, 201201, 6),  # a year that starts on Sunday has no week 0
    ("2012-01-07 23:59:59", 1, 201201, 5),
    ("2012-01-08 00:00:00", 2, 201202, 6),
    ("2012-12-29 10:00:00", 52, 201252, 5),
    ("2012-12-30 10:00:00", 53, 201253, 6),  # the last Sunday of the year
    ("2012-12-31 10:00:00", 53, 201253, 0),
    ("2013-01-01 00:00:00", 0, 201253, 1),  # before the first Sunday: week 0, the old year's last week
    ("2013-01-05 23:59:59", 0, 201253, 5),
    ("2013-01-06 00:00:00", 1, 201301, 6),
    ("2024-02-29 06:00:00", 8, 202408, 3),
]


@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    assert register_sql_functions(spark) == ["week", "yearweek"]


@pytest.mark.parametrize("day,week,yearweek,weekday", DATES)
def test_literal_dates(spark, day, week, yearweek, weekday):
    at = f"TIMESTAMP_NTZ '{day}'"
    got = spark.sql(f"SELECT WEEK({at}), WEEK({at}, 0), YEARWEEK({at}), YEARWEEK({at}, 0), WEEKDAY({at}), HOUR({at})").first()
    assert tuple(got) == (week, week, yearweek, yearweek, weekday, int(day[11:13]))


def test_columns_in_a_query(spark):
    values = ", ".join(f"(TIMESTAMP_NTZ '{d}')" for d, *_ in DATES)
    df = spark.sql(f"SELECT YEARWEEK(d) AS yw, max(WEEK(d)) AS wk, count(*) AS n FROM VALUES {values} AS t(d) GROUP BY 1")
    want = {}
    for _, week, yearweek, _ in DATES:
        top, n = want.get(yearweek, (0, 0))
        want[yearweek] = (max(top, week), n + 1)
    assert {r.yw: (r.wk, r.n) for r in df.collect()} == want
    assert not plan_summary(df)["python"]


def test_other_week_modes_rejected(spark):
    with pytest.raises(Exception):
        spark.sql("SELECT WEEK(TIMESTAMP_NTZ '2024-01-01 00:00:00', 3)").collect()
