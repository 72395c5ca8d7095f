"""Plan-level pieces: skew-safe join shapes, plan inspection, the query
registry and its DuckDB oracle twins."""

from sessionscope.plans.joins import hot_key_left_join
from sessionscope.plans.inspect import plan_summary, plan_text

__all__ = ["hot_key_left_join", "plan_summary", "plan_text"]
