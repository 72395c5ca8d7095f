"""Derive the shop tables from the driver's ``events`` table.

``events(event_id, ts, user_id, event_type, value, props)`` becomes

* ``website_sessions``  one session = one user on one calendar day,
* ``website_pageviews`` one pageview per event,
* ``shop_orders``       one order per purchase event.

Everything is column expressions: the pageview and order tables are narrow
projections of the scan (no shuffle), the session table is one aggregation on
the session id with a map-side partial ``min``.  Because the aggregation key is
exactly ``website_session_id``, the session table comes out hash-partitioned on
the join key every operator uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.sources.marks import mark_session_day, mark_sessions
from sessionscope.sources.schemas import ORDER_ID, PAGEVIEW_ID, SESSION_ID

# ---------------------------------------------------------------------------
# Fixed values of the fixture derivation.  They must stay exactly as written.
# ---------------------------------------------------------------------------
# website_session_id = (user_id * 10000 + year) * 1000 + day_of_year
YEAR_STRIDE, DAY_STRIDE = 10_000, 1000

# Traffic attributes by bucket b = (user_id * 7 + day_of_year) % 10, b = 0 … 9.
UTM_SOURCE_BY_BUCKET = [
    "gsearch", "gsearch", "gsearch", "gsearch", "bsearch",
    "bsearch", "gsearch", None, None, "socialbook",
]
UTM_CAMPAIGN_BY_BUCKET = [
    "nonbrand", "nonbrand", "nonbrand", "nonbrand", "nonbrand",
    "nonbrand", "brand", None, None, "pilot",
]
HTTP_REFERER_BY_BUCKET = [
    "https://www.gsearch.com", "https://www.gsearch.com", "https://www.gsearch.com",
    "https://www.gsearch.com", "https://www.bsearch.com", "https://www.bsearch.com",
    "https://www.gsearch.com", "https://www.gsearch.com", None,
    "https://www.socialbook.com",
]
# Device by v = (user_id + day_of_year) % 3: v = 0 is mobile, else desktop.
MOBILE_DEVICE, DESKTOP_DEVICE = "mobile", "desktop"

# Page of an event: (event_type, test on k, switch date or None, url when the
# test holds (and ts >= switch date), url otherwise).  A NULL k fails the test.
PAGE_RULES = [
    ("view", ">= 50", "2024-01-08", "/lander-1", "/home"),
    ("click", "< 50", None, "/products", "/the-original-mr-fuzzy"),
    ("signup", "< 50", None, "/cart", "/shipping"),
    ("error", ">= 50", "2024-01-12", "/billing-2", "/billing"),
    ("purchase", None, None, "/thank-you-for-your-order", "/thank-you-for-your-order"),
]
ORDER_EVENT_TYPE = "purchase"
# ---------------------------------------------------------------------------


def _sql_str(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pick_sql(values: list[str | None], index_sql: str) -> str:
    """Entry ``index`` (0-based) of a literal list: one array lookup (compact
    when Catalyst pushes a filter on it into the scan); NULL for an index
    outside the list, never an error, also under ANSI mode."""
    items = ", ".join(f"CAST({_sql_str(v)} AS STRING)" for v in values)
    return (
        f"CASE WHEN ({index_sql}) BETWEEN 0 AND {len(values) - 1} "
        f"THEN element_at(array({items}), ({index_sql}) + 1) END"
    )


# The expressions are written as SQL text: one JVM call builds each of them,
# and Catalyst sees exactly the same expression trees as with Column methods.
SESSION_ID_SQL = f"(user_id * {YEAR_STRIDE} + year(ts)) * {DAY_STRIDE} + dayofyear(ts)"


def _page_url_sql() -> str:
    key = "try_cast(get_json_object(props, '$.k') AS INT)"
    branches = []
    for etype, k_test, switch, then_url, else_url in PAGE_RULES:
        if k_test is None:
            url = _sql_str(then_url)
        else:
            test = f"{key} {k_test}"
            if switch is not None:
                test = f"ts >= CAST('{switch}' AS TIMESTAMP_NTZ) AND {test}"
            # a NULL test (NULL k) takes the "otherwise" url
            url = f"CASE WHEN coalesce({test}, false) THEN {_sql_str(then_url)} ELSE {_sql_str(else_url)} END"
        branches.append(f"WHEN event_type = {_sql_str(etype)} THEN {url}")
    return "CASE " + " ".join(branches) + " END"


def session_attributes_sql() -> list[str]:
    """Projection from (website_session_id, created_at) to the session row."""
    user = f"({SESSION_ID} div {YEAR_STRIDE * DAY_STRIDE})"  # exact integer division
    doy = f"({SESSION_ID} % {DAY_STRIDE})"
    bucket = f"CAST(({user} * 7 + {doy}) % 10 AS INT)"
    return [
        SESSION_ID,
        "created_at",
        f"{_pick_sql(UTM_SOURCE_BY_BUCKET, bucket)} AS utm_source",
        f"{_pick_sql(UTM_CAMPAIGN_BY_BUCKET, bucket)} AS utm_campaign",
        f"CASE WHEN ({user} + {doy}) % 3 = 0 THEN {_sql_str(MOBILE_DEVICE)} "
        f"ELSE {_sql_str(DESKTOP_DEVICE)} END AS device_type",
        f"{_pick_sql(HTTP_REFERER_BY_BUCKET, bucket)} AS http_referer",
    ]


def sessions_from_events(events: DataFrame, token: str | None = None) -> DataFrame:
    """The sessions, with their events kept at hand for :func:`sessions_within`.

    Events without a user or a time belong to no session; they stay pageviews (and
    orders) without a session id.  ``token`` names the events, so that pageviews derived
    from the same ones are known to lie on the day of their session.
    """
    known = events.where("user_id IS NOT NULL AND ts IS NOT NULL")
    per_session = known.groupBy(F.expr(SESSION_ID_SQL).alias(SESSION_ID)).agg(F.min("ts").alias("created_at"))
    sessions = per_session.selectExpr(*session_attributes_sql())
    if token is not None:
        sessions = mark_sessions(sessions, token)
    sessions._session_events = events, token
    return sessions


def sessions_within(sessions: DataFrame, day_start_sql: str | None, end_sql: str | None) -> DataFrame:
    """``sessions`` from the events that can decide a window of ``created_at``.

    A session's ``created_at`` is the smallest ``ts`` of its day.  Events at or
    after an upper bound cannot lower it below the bound, and events before the
    first day of the window belong to sessions of earlier days, so both are left
    out at the scan; sessions inside the window come out unchanged.  Frames that
    were not derived here are returned as they are.
    """
    events, token = getattr(sessions, "_session_events", (None, None))
    bounds = " AND ".join(b for b in (day_start_sql, end_sql) if b)
    if events is None or not bounds:
        return sessions
    return sessions_from_events(events.filter(bounds), token)


def pageviews_from_events(events: DataFrame, token: str | None = None) -> DataFrame:
    pageviews = events.selectExpr(
        f"event_id AS {PAGEVIEW_ID}",
        "ts AS created_at",
        f"{SESSION_ID_SQL} AS {SESSION_ID}",
        f"{_page_url_sql()} AS pageview_url",
    )
    # a session is one calendar day, so a pageview's own day is its session's
    return pageviews if token is None else mark_session_day(pageviews, token, "created_at")


def orders_from_events(events: DataFrame) -> DataFrame:
    return events.filter(f"event_type = {_sql_str(ORDER_EVENT_TYPE)}").selectExpr(
        f"event_id AS {ORDER_ID}",
        "ts AS created_at",
        f"{SESSION_ID_SQL} AS {SESSION_ID}",
        "value AS price_usd",
    )
