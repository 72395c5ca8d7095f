"""Reading stored session facts (:mod:`sessionscope.rollups.session_facts`)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.sources.schemas import SESSION_ID

# columns of the stored facts
FACTS, PAGES, AFTER, VARIANT, VARIANTS = "_facts", "_page_firsts", "_after_launch", "_variant", "_variants"
_TOLD = "sessionscope.facts"


def mark_facts(facts: DataFrame, told: str) -> DataFrame:
    """Say which pages and launches the facts hold."""
    return facts.withMetadata(FACTS, {_TOLD: told})


def holds_facts(df: DataFrame) -> bool:
    """Whether rows are stored facts of sessions instead of sessions or pageviews."""
    return {FACTS, PAGES, AFTER, VARIANT, VARIANTS} <= set(df.columns)


def _place(facts: DataFrame, kind: str, page: str) -> int:
    known = json.loads(facts.schema[FACTS].metadata[_TOLD])[kind]
    if page not in known:
        raise ValueError(f"the stored facts hold no {kind} entry for {page!r}, only {known}")
    return known.index(page)


def first_on(facts: DataFrame, page: str) -> Column:
    """First pageview id on ``page``, NULL where the session never saw it."""
    return F.col(PAGES)[_place(facts, "pages", page)]


def first_after(facts: DataFrame, page: str) -> Column:
    """(id, url, at) of the first pageview after the launch of ``page``."""
    return F.col(AFTER)[_place(facts, "launches", page)]


def each_session_once(cohort: DataFrame) -> DataFrame:
    """One row for each session of filtered facts.

    Only sessions whose rows have several sets of attributes can stand there more than
    once; they alone are grouped.
    """
    one, more = cohort.where(f"{VARIANTS} = 1"), cohort.where(f"{VARIANTS} > 1")
    return one.unionByName(more.dropDuplicates([SESSION_ID]))
