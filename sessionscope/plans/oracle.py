"""DuckDB twins of the registered queries (the correctness oracle).

Written independently of the DataFrame operators, in DuckDB's own idioms:
``count(DISTINCT …) FILTER (WHERE …)`` for conditional counts, ``arg_min``
for the URL and time of a session's first pageview, one table of per-session
pageview facts joined to each cohort, ``IN`` semi-joins and scalar
subqueries for launch ids.  Only ``events`` is registered in
DuckDB, so every query starts with CTEs that derive ``website_sessions``,
``website_pageviews`` and ``shop_orders`` by the fixture rules.  Types are cast
to match Spark (calendar parts INTEGER, counts BIGINT, ratios DOUBLE).
"""

from __future__ import annotations

_BASE_CTES = """
ev AS (
    SELECT event_id, ts, user_id, event_type, value,
           dayofyear(ts) AS doy,
           (user_id * 10000 + year(ts)) * 1000 + dayofyear(ts) AS session_id,
           TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events
),
session_base AS (
    SELECT session_id AS website_session_id,
           MIN(ts) AS created_at,
           (user_id * 7 + doy) % 10 AS b,
           (user_id + doy) % 3 AS v
    FROM ev
    WHERE session_id IS NOT NULL
    GROUP BY user_id, doy, session_id
),
website_sessions AS (
    SELECT website_session_id, created_at,
           CASE WHEN b IN (0, 1, 2, 3, 6) THEN 'gsearch'
                WHEN b IN (4, 5) THEN 'bsearch'
                WHEN b = 9 THEN 'socialbook' END AS utm_source,
           CASE WHEN b BETWEEN 0 AND 5 THEN 'nonbrand'
                WHEN b = 6 THEN 'brand'
                WHEN b = 9 THEN 'pilot' END AS utm_campaign,
           CASE WHEN v = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
           CASE WHEN b IN (0, 1, 2, 3, 6, 7) THEN 'https://www.gsearch.com'
                WHEN b IN (4, 5) THEN 'https://www.bsearch.com'
                WHEN b = 9 THEN 'https://www.socialbook.com' END AS http_referer
    FROM session_base
),
website_pageviews AS (
    SELECT event_id AS website_pageview_id,
           ts AS created_at,
           session_id AS website_session_id,
           CASE event_type
             WHEN 'view' THEN CASE WHEN ts >= TIMESTAMP '2024-01-08' AND k >= 50
                                   THEN '/lander-1' ELSE '/home' END
             WHEN 'click' THEN CASE WHEN k < 50 THEN '/products'
                                    ELSE '/the-original-mr-fuzzy' END
             WHEN 'signup' THEN CASE WHEN k < 50 THEN '/cart' ELSE '/shipping' END
             WHEN 'error' THEN CASE WHEN ts >= TIMESTAMP '2024-01-12' AND k >= 50
                                    THEN '/billing-2' ELSE '/billing' END
             WHEN 'purchase' THEN '/thank-you-for-your-order'
           END AS pageview_url
    FROM ev
),
shop_orders AS (
    SELECT event_id AS order_id, ts AS created_at,
           session_id AS website_session_id, value AS price_usd
    FROM ev
    WHERE event_type = 'purchase'
)"""


def _q(body: str, *ctes: str) -> tuple[str, tuple[str, ...]]:
    return body, ctes


def _compose(body: str, ctes: tuple[str, ...], with_base: bool) -> str:
    parts = ([_BASE_CTES.strip()] if with_base else []) + [c.strip() for c in ctes]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def _ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


def _week0(col: str) -> str:
    # Sunday-start week number, week 0 before the first Sunday
    return f"CAST(strftime({col}, '%U') AS INTEGER)"


def _yearweek(col: str) -> str:
    # the Sunday on/before the day (DuckDB dayofweek: Sunday = 0), then its year and %U week
    sunday = f"(CAST({col} AS DATE) - CAST(dayofweek({col}) AS INTEGER))"
    return f"CAST(year({sunday}) * 100 + CAST(strftime({sunday}, '%U') AS INTEGER) AS INTEGER)"


def _div(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF({den}, 0)"


_PAID = "utm_source = 'gsearch' AND utm_campaign = 'nonbrand'"
_BILLING_PAGES = "('/billing', '/billing-2')"
_STEPS = [  # url, page flag, session flag, reached count, rate over the previous step
    ("/products", "products_page", "product_made_it", "to_products", "lander_click_rt"),
    ("/the-original-mr-fuzzy", "mrfuzzy_page", "mrfuzzy_made_it", "to_mrfuzzy", "products_to_mrfuzzy"),
    ("/cart", "cart_page", "cart_made_it", "to_cart", "mrfuzzy_to_cart"),
    ("/shipping", "shipping_page", "shipping_made_it", "to_shipping", "cart_to_shipping"),
    ("/billing", "billing_page", "billing_made_it", "to_billing", "shipping_to_billing"),
    ("/thank-you-for-your-order", "thankyou_page", "thankyou_made_it", "to_thankyou", "billing_to_thankyou"),
]


def _share(part: str, whole: str) -> str:
    return _div(part, whole)


# Per-session pageview facts over all pageviews: count, first id, and the URL
# and time at the first id (arg_min), computed once and joined to cohorts.
_PV_FACTS = """
pv_facts AS (
    SELECT website_session_id,
           count(*) AS n_views,
           min(website_pageview_id) AS first_id,
           arg_min(pageview_url, website_pageview_id) AS first_url,
           arg_min(created_at, website_pageview_id) AS first_at
    FROM website_pageviews
    GROUP BY website_session_id
)"""

# bounce chain: landing page among pageviews before the cutoff
_HOME_LANDED = f"""
early_entry AS (
    SELECT website_session_id, arg_min(pageview_url, website_pageview_id) AS entry_url
    FROM website_pageviews
    WHERE created_at < {_ts('2024-01-22')}
    GROUP BY website_session_id
),
home_landed AS (
    SELECT e.website_session_id, e.entry_url AS landing_page, f.n_views
    FROM early_entry e JOIN pv_facts f USING (website_session_id)
    WHERE e.entry_url = '/home'
)"""

# landing test: first pageview after the launch id, cohort by session filters
_TEST_LANDED = f"""
lander_start AS (
    SELECT min(website_pageview_id) AS launch_id
    FROM website_pageviews
    WHERE pageview_url = '/lander-1' AND created_at IS NOT NULL
),
test_cohort AS (
    SELECT website_session_id FROM website_sessions
    WHERE {_PAID} AND created_at < {_ts('2024-01-28')}
),
post_launch AS (
    SELECT website_session_id,
           min(website_pageview_id) AS min_pageview_id,
           arg_min(pageview_url, website_pageview_id) AS landing_page
    FROM website_pageviews
    WHERE website_pageview_id > (SELECT launch_id FROM lander_start)
      AND website_session_id IN (SELECT website_session_id FROM test_cohort)
    GROUP BY website_session_id
),
test_landed AS (
    SELECT a.website_session_id, a.landing_page, f.n_views
    FROM post_launch a JOIN pv_facts f USING (website_session_id)
    WHERE a.landing_page IN ('/home', '/lander-1')
)"""

# landing trend: cohort sessions (closed window) with their pageview facts
_TREND = f"""
trend_cohort AS (
    SELECT DISTINCT website_session_id FROM website_sessions
    WHERE {_PAID}
      AND created_at BETWEEN {_ts('2024-01-02')} AND {_ts('2024-01-29')}
),
trend AS (
    SELECT c.website_session_id,
           f.first_id AS first_pageview_id,
           coalesce(f.n_views, 0) AS count_pageviews,
           f.first_url AS landing_page,
           f.first_at AS session_created_at
    FROM trend_cohort c LEFT JOIN pv_facts f USING (website_session_id)
)"""

# funnel: cohort sessions (open window) and every pageview of theirs
_FUNNEL_COHORT = f"""
funnel_cohort AS (
    SELECT website_session_id FROM website_sessions
    WHERE {_PAID}
      AND created_at > {_ts('2024-01-05')} AND created_at < {_ts('2024-01-25')}
)"""
_REACH = _FUNNEL_COHORT + ",\nreach AS (\n    SELECT c.website_session_id,\n" + ",\n".join(
    f"           coalesce(CAST(bool_or(p.pageview_url = '{url}') AS INTEGER), 0) AS {made}"
    for url, _, made, _, _ in _STEPS
) + """
    FROM funnel_cohort c LEFT JOIN website_pageviews p USING (website_session_id)
    GROUP BY c.website_session_id
)"""

# billing test: billing pageviews from the new page's first id on
_BILLING = f"""
billing_start AS (
    SELECT min(website_pageview_id) AS launch_id
    FROM website_pageviews WHERE pageview_url = '/billing-2'
),
billing_views AS (
    SELECT website_session_id, pageview_url AS billing_version_seen
    FROM website_pageviews
    WHERE website_pageview_id >= (SELECT launch_id FROM billing_start)
      AND created_at < {_ts('2024-01-28')}
      AND pageview_url IN {_BILLING_PAGES}
)"""

_CHANNEL = """CASE
        WHEN utm_source IS NULL AND http_referer IN ('https://www.gsearch.com', 'https://www.bsearch.com')
            THEN 'organic_search'
        WHEN utm_campaign = 'nonbrand' THEN 'paid_nonbrand'
        WHEN utm_campaign = 'brand' THEN 'paid_brand'
        WHEN utm_source IS NULL AND http_referer IS NULL THEN 'direct_type_in'
    END"""


def _n_if(cond: str, key: str = "website_session_id") -> str:
    return f"count(DISTINCT {key}) FILTER (WHERE {cond})"


_QUERIES: dict[str, tuple[str, tuple[str, ...]]] = {
    # ---------------------------------------------------------------- traffic
    "top_traffic_sources": _q(f"""
SELECT utm_source, utm_campaign, http_referer,
       count(DISTINCT website_session_id) AS number_of_sessions
FROM website_sessions
WHERE created_at < {_ts('2024-01-20')}
GROUP BY ALL
ORDER BY number_of_sessions DESC"""),
    "conversion_rate": _q(
        f"""
SELECT (SELECT count(*) FROM paid_cohort) AS total_sessions,
       count(DISTINCT order_id) AS total_orders,
       round({_div("count(DISTINCT order_id) * 100", "(SELECT count(*) FROM paid_cohort)")}, 2) AS conversion_rate
FROM shop_orders
WHERE website_session_id IN (SELECT website_session_id FROM paid_cohort)""",
        f"""
paid_cohort AS (
    SELECT DISTINCT website_session_id FROM website_sessions
    WHERE {_PAID} AND created_at < {_ts('2024-01-20')}
)""",
    ),
    "weekly_session_trend": _q(f"""
SELECT min(CAST(created_at AS DATE)) AS week_started_at,
       count(DISTINCT website_session_id) AS sessions
FROM website_sessions
WHERE {_PAID} AND created_at < {_ts('2024-01-31')}
GROUP BY year(created_at), {_week0('created_at')}
ORDER BY week_started_at"""),
    "conversion_by_device": _q(
        f"""
SELECT device_type, n AS sessions, coalesce(m, 0) AS orders, {_share("coalesce(m, 0)", "n")} AS session_to_order_cvr
FROM of_sessions LEFT JOIN of_orders USING (device_type)""",
        f"""
members AS (
    SELECT DISTINCT device_type, website_session_id FROM website_sessions
    WHERE {_PAID} AND created_at < {_ts('2024-01-20')}
),
of_sessions AS (SELECT device_type, count(*) AS n FROM members GROUP BY ALL),
of_orders AS (
    SELECT device_type, count(DISTINCT order_id) AS m
    FROM shop_orders JOIN members USING (website_session_id) GROUP BY ALL
)""",
    ),
    "weekly_sessions_by_device": _q(f"""
SELECT CAST(year(created_at) AS INTEGER) AS yr,
       {_week0('created_at')} AS wk,
       min(CAST(created_at AS DATE)) AS week_start_date,
       {_n_if("device_type = 'desktop'")} AS desktop_sessions,
       {_n_if("device_type = 'mobile'")} AS mobile_sessions,
       count(DISTINCT website_session_id) AS total_sessions
FROM website_sessions
WHERE {_PAID} AND created_at > {_ts('2024-01-03')} AND created_at < {_ts('2024-01-29')}
GROUP BY ALL
ORDER BY yr, wk"""),
    # ------------------------------------------------------------ seasonality
    "weekly_sessions_orders": _q(
        """
SELECT yr, wk, week_start, sessions, coalesce(m, 0) AS orders
FROM of_sessions LEFT JOIN of_orders USING (yr, wk)
ORDER BY yr, wk""",
        f"""
members AS (
    SELECT website_session_id, created_at, CAST(year(created_at) AS INTEGER) AS yr, {_week0('created_at')} AS wk
    FROM website_sessions
    WHERE created_at < {_ts('2024-01-31')}
),
of_sessions AS (
    SELECT yr, wk, min(CAST(created_at AS DATE)) AS week_start, count(DISTINCT website_session_id) AS sessions
    FROM members GROUP BY ALL
),
of_orders AS (
    SELECT yr, wk, count(DISTINCT order_id) AS m FROM shop_orders JOIN members USING (website_session_id) GROUP BY ALL
)""",
    ),
    "weekly_session_trend_keys": _q(f"""
SELECT CAST(year(created_at) AS INTEGER) AS yr, {_week0('created_at')} AS wk,
       min(CAST(created_at AS DATE)) AS week_started_at,
       count(DISTINCT website_session_id) AS sessions
FROM website_sessions
WHERE {_PAID} AND created_at < {_ts('2024-01-31')}
GROUP BY ALL"""),
    "hourly_weekday_profile": _q(
        """
SELECT hr, round(any_value(overall), 1) AS avg_sessions,
""" + ",\n".join(
            f"       max(mean) FILTER (WHERE wkday = {k}) AS {name}"
            for k, name in enumerate(["mon", "tues", "wed", "thurs", "fri", "sat", "sun"])
        ) + """
FROM by_weekday JOIN by_hour USING (hr)
GROUP BY hr
ORDER BY hr""",
        f"""
seen AS (
    SELECT DISTINCT date_trunc('hour', created_at) AS moment, website_session_id
    FROM website_sessions
    WHERE created_at BETWEEN {_ts('2024-01-05')} AND {_ts('2024-01-25')}
),
hours AS (
    SELECT CAST(hour(moment) AS INTEGER) AS hr, isodow(moment) - 1 AS wkday, count(website_session_id) AS n FROM seen GROUP BY moment
),
by_weekday AS (SELECT hr, wkday, avg(n) AS mean FROM hours GROUP BY ALL),
by_hour AS (SELECT hr, avg(n) AS overall FROM hours GROUP BY ALL)""",
    ),
    # -------------------------------------------------------- channel portfolio
    "weekly_sources": _q(f"""
SELECT {_yearweek('created_at')} AS yrwk,
       min(CAST(created_at AS DATE)) AS week_start_date,
       count(DISTINCT website_session_id) AS total_nonbrand_sessions,
       {_n_if("utm_source = 'gsearch'")} AS gsearch_sessions,
       {_n_if("utm_source = 'bsearch'")} AS bsearch_sessions
FROM website_sessions
WHERE utm_campaign = 'nonbrand'
  AND created_at >= {_ts('2024-01-01')} AND created_at < {_ts('2024-01-31')}
GROUP BY ALL
ORDER BY yrwk"""),
    "source_mobile_share": _q(f"""
SELECT utm_source,
       count(DISTINCT website_session_id) AS sessions,
       {_n_if("device_type = 'mobile'")} AS mobile_sessions,
       {_share(_n_if("device_type = 'mobile'"), "count(DISTINCT website_session_id)")} AS pct_mobile
FROM website_sessions
WHERE utm_campaign = 'nonbrand' AND utm_source IN ('gsearch', 'bsearch')
  AND created_at >= {_ts('2024-01-05')} AND created_at < {_ts('2024-01-25')}
GROUP BY utm_source"""),
    "conversion_by_device_source": _q(
        f"""
SELECT c.device_type, c.utm_source, count(*) AS sessions, coalesce(sum(o.n), 0)::BIGINT AS orders,
       {_share("coalesce(sum(o.n), 0)", "count(*)")} AS conv_rate
FROM members c LEFT JOIN per_session o USING (website_session_id)
GROUP BY ALL""",
        f"""
members AS (
    SELECT DISTINCT website_session_id, device_type, utm_source FROM website_sessions
    WHERE utm_campaign = 'nonbrand'
      AND created_at >= {_ts('2024-01-05')} AND created_at < {_ts('2024-01-25')}
),
per_session AS (
    SELECT website_session_id, count(DISTINCT order_id) AS n FROM shop_orders GROUP BY ALL HAVING n > 0
)""",
    ),
    "weekly_source_device_ratio": _q(
        """
SELECT year_week, any_value(week_start_date) AS week_start_date,
       coalesce(max(n) FILTER (WHERE pair = 'gsearch/desktop'), 0) AS g_dtop_sessions,
       coalesce(max(n) FILTER (WHERE pair = 'bsearch/desktop'), 0) AS b_dtop_sessions,
       """ + _share("b_dtop_sessions", "g_dtop_sessions") + """ AS b_pct_of_g_dtop,
       coalesce(max(n) FILTER (WHERE pair = 'gsearch/mobile'), 0) AS g_mob_sessions,
       coalesce(max(n) FILTER (WHERE pair = 'bsearch/mobile'), 0) AS b_mob_sessions,
       """ + _share("b_mob_sessions", "g_mob_sessions") + """ AS b_pct_of_g_mob
FROM weeks LEFT JOIN long USING (year_week)
GROUP BY year_week
ORDER BY week_start_date""",
        f"""
members AS (
    SELECT *, {_yearweek('created_at')} AS year_week FROM website_sessions
    WHERE utm_campaign = 'nonbrand'
      AND created_at >= {_ts('2024-01-01')} AND created_at < {_ts('2024-01-31')}
),
weeks AS (SELECT year_week, min(CAST(created_at AS DATE)) AS week_start_date FROM members GROUP BY ALL),
long AS (
    SELECT year_week, utm_source || '/' || device_type AS pair, count(DISTINCT website_session_id) AS n
    FROM members GROUP BY ALL
)""",
    ),
    "classify_channel": _q(f"""
SELECT website_session_id, created_at, {_CHANNEL} AS channel_group
FROM website_sessions"""),
    "monthly_channel_mix": _q(
        """
SELECT CAST(m.yr AS INTEGER) AS yr, CAST(m.mo AS INTEGER) AS mo,
       """ + ",\n       ".join(
            f"coalesce(max(n) FILTER (WHERE grp = '{label}'), 0) AS {name}"
            + ("" if name == "nonbrand" else f", {_share(name, 'nonbrand')} AS {name}_pct_of_nonbrand")
            for name, label in [
                ("nonbrand", "paid_nonbrand"), ("brand", "paid_brand"),
                ("direct", "direct_type_in"), ("organic", "organic_search"),
            ]
        ) + """
FROM long m
GROUP BY m.yr, m.mo
ORDER BY yr, mo""",
        f"""
long AS (
    SELECT year(created_at) AS yr, month(created_at) AS mo, {_CHANNEL} AS grp,
           count(DISTINCT website_session_id) AS n
    FROM website_sessions
    WHERE created_at < {_ts('2024-01-31')}
    GROUP BY ALL
)""",
    ),
    # ------------------------------------------------------- pages and bounce
    "top_pages": _q(f"""
SELECT pageview_url, count(DISTINCT website_pageview_id) AS pvs
FROM website_pageviews
WHERE created_at < {_ts('2024-01-22')}
GROUP BY pageview_url
ORDER BY pvs DESC"""),
    "first_pageview_per_session": _q(f"""
SELECT website_session_id, min(website_pageview_id) AS first_pv
FROM website_pageviews
WHERE created_at < {_ts('2024-01-20')}
GROUP BY website_session_id"""),
    "min_pageview_per_session": _q(f"""
SELECT website_session_id, min(website_pageview_id) AS min_pageview_id
FROM website_pageviews
WHERE created_at < {_ts('2024-01-22')}
GROUP BY website_session_id"""),
    "top_entry_pages": _q(f"""
SELECT landing_page_url, count(website_session_id) AS sessions_hitting_page
FROM (
    SELECT website_session_id, arg_min(pageview_url, website_pageview_id) AS landing_page_url
    FROM website_pageviews
    WHERE created_at < {_ts('2024-01-20')}
    GROUP BY website_session_id
)
GROUP BY landing_page_url
ORDER BY sessions_hitting_page DESC"""),
    "sessions_with_landing_page": _q(
        "SELECT website_session_id, landing_page FROM home_landed", _PV_FACTS, _HOME_LANDED
    ),
    "bounced_sessions": _q(
        "SELECT website_session_id, landing_page, n_views AS count_of_pages_viewed FROM home_landed WHERE n_views = 1",
        _PV_FACTS,
        _HOME_LANDED,
    ),
    "bounce_markers": _q(
        """
SELECT website_session_id,
       CASE WHEN n_views = 1 THEN website_session_id END AS bounced_website_session_id
FROM home_landed
ORDER BY website_session_id""",
        _PV_FACTS,
        _HOME_LANDED,
    ),
    "bounce_rate": _q(
        """
SELECT count(*) AS sessions,
       count(*) FILTER (WHERE n_views = 1) AS bounced_sessions,
       """ + _share("count(*) FILTER (WHERE n_views = 1)", "count(*)") + """ AS bounce_rate
FROM home_landed""",
        _PV_FACTS,
        _HOME_LANDED,
    ),
    # ------------------------------------------------- landing-page test / trend
    "page_launch": _q("""
SELECT min(created_at) AS first_created_at, min(website_pageview_id) AS first_pageview_id
FROM website_pageviews
WHERE pageview_url = '/lander-1' AND created_at IS NOT NULL"""),
    "test_first_pageviews": _q(
        "SELECT website_session_id, min_pageview_id FROM post_launch", _PV_FACTS, _TEST_LANDED
    ),
    "test_landing_pages": _q(
        "SELECT website_session_id, landing_page FROM test_landed", _PV_FACTS, _TEST_LANDED
    ),
    "test_bounced_sessions": _q(
        "SELECT website_session_id, landing_page, n_views AS count_of_pages_viewed FROM test_landed WHERE n_views = 1",
        _PV_FACTS,
        _TEST_LANDED,
    ),
    "test_bounce_markers": _q(
        """
SELECT landing_page, website_session_id,
       CASE WHEN n_views = 1 THEN website_session_id END AS bounced_website_session_id
FROM test_landed
ORDER BY website_session_id""",
        _PV_FACTS,
        _TEST_LANDED,
    ),
    "bounce_rate_by_landing_page": _q(
        """
SELECT landing_page,
       count(*) AS sessions,
       count(*) FILTER (WHERE n_views = 1) AS bounced_sessions,
       """ + _share("count(*) FILTER (WHERE n_views = 1)", "count(*)") + """ AS bounce_rate
FROM test_landed
GROUP BY landing_page""",
        _PV_FACTS,
        _TEST_LANDED,
    ),
    "session_first_pv_and_count": _q(
        "SELECT website_session_id, first_pageview_id, count_pageviews FROM trend", _PV_FACTS, _TREND
    ),
    "session_landing_details": _q(
        """
SELECT website_session_id, first_pageview_id, count_pageviews, landing_page, session_created_at
FROM trend""",
        _PV_FACTS,
        _TREND,
    ),
    "weekly_bounce_trend": _q(
        f"""
SELECT min(CAST(session_created_at AS DATE)) AS week_start_date,
       {_share("count(*) FILTER (WHERE count_pageviews = 1)", "count(*)")} AS bounce_rate,
       count(*) FILTER (WHERE landing_page = '/home') AS home_sessions,
       count(*) FILTER (WHERE landing_page = '/lander-1') AS lander_sessions
FROM trend
GROUP BY {_yearweek('session_created_at')}
ORDER BY {_yearweek('session_created_at')}""",
        _PV_FACTS,
        _TREND,
    ),
    "weekly_bounce_trend_counts": _q(
        f"""
SELECT {_yearweek('session_created_at')} AS year_week,
       min(CAST(session_created_at AS DATE)) AS week_start_date,
       count(*) AS total_sessions,
       count(*) FILTER (WHERE count_pageviews = 1) AS bounced_sessions,
       {_share("count(*) FILTER (WHERE count_pageviews = 1)", "count(*)")} AS bounce_rate,
       count(*) FILTER (WHERE landing_page = '/home') AS home_sessions,
       count(*) FILTER (WHERE landing_page = '/lander-1') AS lander_sessions
FROM trend
GROUP BY ALL""",
        _PV_FACTS,
        _TREND,
    ),
    # ------------------------------------------------------------------ funnel
    "funnel_pageview_flags": _q(
        "SELECT c.website_session_id, p.pageview_url, p.created_at AS pageview_created_at,\n"
        + ",\n".join(
            f"       coalesce(CAST(p.pageview_url = '{url}' AS INTEGER), 0) AS {page}"
            for url, page, _, _, _ in _STEPS
        )
        + """
FROM funnel_cohort c LEFT JOIN website_pageviews p USING (website_session_id)
ORDER BY c.website_session_id, p.created_at""",
        _FUNNEL_COHORT,
    ),
    "session_funnel_flags": _q(
        "SELECT website_session_id, " + ", ".join(made for _, _, made, _, _ in _STEPS) + " FROM reach",
        _REACH,
    ),
    "funnel_counts": _q(
        "SELECT count(*) AS sessions,\n"
        + ",\n".join(f"       count(*) FILTER (WHERE {made} = 1) AS {to}" for _, _, made, to, _ in _STEPS)
        + "\nFROM reach",
        _REACH,
    ),
    "funnel_rates": _q(
        "SELECT "
        + ",\n       ".join(
            _share(f"count(*) FILTER (WHERE {made} = 1)", f"count(*) FILTER (WHERE {prev} = 1)" if prev else "count(*)")
            + f" AS {rate}"
            for (_, _, made, _, rate), prev in zip(_STEPS, [None] + [st[2] for st in _STEPS[:-1]])
        )
        + "\nFROM reach",
        _REACH,
    ),
    # ------------------------------------------------------------ billing test
    "variant_launch": _q("""
SELECT min(website_pageview_id) AS first_pv_id
FROM website_pageviews
WHERE pageview_url = '/billing-2'"""),
    "variant_sessions_orders": _q(
        """
SELECT v.website_session_id, v.billing_version_seen, o.order_id
FROM billing_views v LEFT JOIN shop_orders o USING (website_session_id)""",
        _BILLING,
    ),
    "variant_conversion": _q(
        """
SELECT billing_version_seen, sessions, coalesce(m, 0) AS orders, """ + _share("coalesce(m, 0)", "sessions") + """ AS billing_to_order_rt
FROM (SELECT billing_version_seen, count(DISTINCT website_session_id) AS sessions FROM billing_views GROUP BY ALL)
LEFT JOIN (
    SELECT billing_version_seen, count(DISTINCT order_id) AS m
    FROM shop_orders o JOIN (SELECT DISTINCT * FROM billing_views) USING (website_session_id)
    GROUP BY ALL
) USING (billing_version_seen)""",
        _BILLING,
    ),
}


# DuckDB SQL over the events table (the shop tables derived as CTEs).
ORACLE_SQL: dict[str, str] = {k: _compose(b, c, True) for k, (b, c) in _QUERIES.items()}


def oracle_on_shop_tables(name: str) -> str:
    """The same query over tables named website_sessions, website_pageviews
    and shop_orders (e.g. hand-made or random fixtures registered in DuckDB)."""
    body, ctes = _QUERIES[name]
    return _compose(body, ctes, False)
