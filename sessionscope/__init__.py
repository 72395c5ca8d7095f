"""sessionscope: web-shop clickstream analytics as Spark DataFrame operators.

Layout
------
``sources``    load / derive the three shop tables (sessions, pageviews, orders)
``functions``  column-level helpers: calendar buckets, time windows, ratios
``operators``  the analytics operators (traffic, seasonality, channel, pages,
               landing tests, funnels, variant tests)
``plans``      join shapes that stay skew-safe, plan checks, the query registry
               and its DuckDB oracle twins
``streaming``  incremental (Structured Streaming) maintenance of the shop tables
"""

from sessionscope.session import build_session, ensure_checkpoint_dir
from sessionscope.sources.tables import ShopTables

__version__ = "0.1.0"

__all__ = ["ShopTables", "build_session", "ensure_checkpoint_dir"]
