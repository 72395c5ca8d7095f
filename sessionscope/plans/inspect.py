"""Read a DataFrame's physical plan (``explain``) and summarise its shape.

Used by tests to hold the operators to the plan shapes they are designed for:
no ``Expand`` from multi-distinct aggregation, no Python evaluation in the hot
path, filters pushed into the Parquet scan, a bounded number of exchanges.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict[str, object]:
    """Counts of the operators that matter for cost, from the final plan."""
    text = plan_text(df, "formatted")
    physical = text.split("\n\n(")[0]
    return {
        "exchanges": len(re.findall(r"Exchange", physical)) - len(re.findall(r"ReusedExchange", physical)),
        "expand": "Expand" in physical,
        "python": bool(re.search(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas", physical)),
        "cartesian": "CartesianProduct" in physical or "BroadcastNestedLoopJoin" in physical,
        "pushed_filters": re.findall(r"PushedFilters: \[([^\]]*)\]", text),
        "read_schemas": re.findall(r"ReadSchema: (struct<[^>]*>)", text),
        "text": text,
    }
