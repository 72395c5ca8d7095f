"""One written row of facts for each session, shared by the page, landing and funnel analyses.

The chains of these analyses (landing pages, bounces, rates, trends, funnel steps) all
ask the same of a session's pageviews: the first id with its URL and time, the number,
the first id on each page of interest, and the first view after a page's launch.
:func:`build_session_facts` gathers them in one grouping of sessions and pageviews and
stores them beside the session's attributes, partitioned by the session's day.
:func:`read_session_facts` returns a frame that takes the place of both the sessions and
the pageviews in the operators; a chain then reads no pageview, groups nothing by
session, and its windows on sessions skip days.

Rows: one for each session and each distinct set of attributes that its rows have
(``_variant`` of ``_variants``; almost always 1 of 1), and one without attributes for a
session that only pageviews name.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.facts import AFTER, FACTS, PAGES, VARIANT, VARIANTS, mark_facts
from sessionscope.operators.common import sql_string
from sessionscope.operators.landing import launch_pageview_id
from sessionscope.sources.marks import CREATED, PARTITION_DATE, mark_day_partition
from sessionscope.sources.schemas import PAGEVIEW_ID, SESSION_ID, SESSIONS_SCHEMA
from sessionscope.sources.tables import ShopTables

_ATTRIBUTES = [f.name for f in SESSIONS_SCHEMA.fields if f.name != SESSION_ID]
_FIRST = "struct<id: bigint, url: string, at: timestamp_ntz>"
_SCHEMA = ", ".join(
    [
        f"{SESSION_ID} bigint",
        *[f"{f.name} {f.dataType.simpleString()}" for f in SESSIONS_SCHEMA.fields if f.name != SESSION_ID],
        f"{VARIANT} int",
        f"{VARIANTS} int",
        f"{FACTS} struct<first: {_FIRST}, n: bigint>",
        f"{PAGES} array<bigint>",
        f"{AFTER} array<{_FIRST}>",
        f"{PARTITION_DATE} date",
    ]
)


def _first(when: str = "TRUE") -> str:
    """(id, URL, time) of the pageview with the smallest id among those where ``when`` holds."""
    return (
        f"min_by(CASE WHEN {when} THEN struct({PAGEVIEW_ID} AS id, pageview_url AS url, _viewed_at AS at) END, "
        f"CASE WHEN {when} THEN {PAGEVIEW_ID} END)"
    )


def build_session_facts(
    shop: ShopTables, root: str, *, pages: tuple[str, ...] = (), launches: tuple[str, ...] = ()
) -> None:
    """Store the facts of all sessions below ``root``, a new folder.

    ``pages`` are the pages whose first id is kept, ``launches`` those after whose first
    view the session's first view is kept; operators that ask for others are refused.

    Needs what the tables promise, that pageview ids rise with time within a session; a
    session that breaks it is an error, because then a window on pageviews could change
    which view is the first.

    Defined cases: sessions without pageviews have no first view and the number 0;
    pageviews without a session id are left out; repeated session rows are one, repeated
    pageview rows count as often as they stand there, as in the analyses themselves.
    """
    spark = shop.pageviews.sparkSession
    views = shop.pageviews.where(f"{SESSION_ID} IS NOT NULL").select(
        SESSION_ID, PAGEVIEW_ID, "pageview_url", F.col(CREATED).alias("_viewed_at")
    )
    for i, page in enumerate(launches):
        launch = launch_pageview_id(shop.pageviews, page)
        views = views.withColumn(f"_after_{i}", F.col(PAGEVIEW_ID) > launch)
    members = shop.sessions.select(SESSION_ID, F.struct(*_ATTRIBUTES).alias("_row"))
    both = views.unionByName(members, allowMissingColumns=True)
    firsts = [f"min(CASE WHEN pageview_url = {sql_string(p)} THEN {PAGEVIEW_ID} END)" for p in pages]
    after = [_first(f"_after_{i}") for i in range(len(launches))]
    per_session = both.groupBy(SESSION_ID).agg(
        F.collect_set("_row").alias("_rows"),
        F.struct(F.expr(_first()).alias("first"), F.count(PAGEVIEW_ID).alias("n")).alias(FACTS),
        F.min("_viewed_at").alias("_earliest"),
        F.array(*[F.expr(x) for x in firsts]).cast("array<bigint>").alias(PAGES),
        F.array(*[F.expr(x) for x in after]).cast(f"array<{_FIRST}>").alias(AFTER),
    )
    path = os.path.join(root, "session_facts")
    listed = per_session.select("*", F.posexplode_outer(F.sort_array("_rows")).alias("_at", "_one"))
    (
        listed.select(
            SESSION_ID,
            *[F.col(f"_one.{a}").alias(a) for a in _ATTRIBUTES],
            F.coalesce(F.col("_at") + 1, F.lit(1)).alias(VARIANT),
            F.greatest(F.size("_rows"), F.lit(1)).alias(VARIANTS),
            FACTS,
            PAGES,
            AFTER,
            (F.col(f"{FACTS}.first.at") > F.col("_earliest")).alias("_out_of_order"),
            F.to_date(f"_one.{CREATED}").alias(PARTITION_DATE),
        )
        .repartitionByRange(PARTITION_DATE, SESSION_ID)
        .write.partitionBy(PARTITION_DATE)
        .parquet(path)
    )
    wrong = spark.read.schema(f"{SESSION_ID} bigint, _out_of_order boolean").parquet(path).where("_out_of_order").count()
    if wrong:
        raise ValueError(f"{wrong} sessions have pageview ids that do not rise with time")
    told = json.dumps({"pages": list(pages), "launches": list(launches)})
    spark.createDataFrame([(told,)], "told string").coalesce(1).write.json(os.path.join(root, "facts"))


def read_session_facts(spark: SparkSession, root: str) -> DataFrame:
    """The stored facts, to be given to operators in place of sessions and pageviews."""
    told = spark.read.schema("told string").json(os.path.join(root, "facts")).first()["told"]
    facts = spark.read.schema(_SCHEMA).parquet(os.path.join(root, "session_facts"))
    return mark_facts(mark_day_partition(facts, f"facts of {root}"), told)
