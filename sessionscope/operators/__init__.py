"""Analytics operators: functions from shop DataFrames to a result DataFrame."""

from sessionscope.operators.channel import (
    channel_group,
    classify_channel,
    conversion_by_device_source,
    monthly_channel_mix,
    source_mobile_share,
    weekly_source_device_ratio,
    weekly_sources,
)
from sessionscope.operators.funnel import (
    DEFAULT_STEPS,
    FunnelStep,
    funnel_counts,
    funnel_pageview_flags,
    funnel_rates,
    session_funnel_flags,
)
from sessionscope.operators.landing import (
    bounce_rate_by_landing_page,
    launch_pageview_id,
    page_launch,
    session_first_pv_and_count,
    session_landing_details,
    test_bounce_markers,
    test_bounced_sessions,
    test_first_pageviews,
    test_landing_pages,
    weekly_bounce_trend,
)
from sessionscope.operators.pages import (
    bounce_markers,
    bounce_rate,
    bounced_sessions,
    first_pageview_per_session,
    landing_profile,
    sessions_with_landing_page,
    top_entry_pages,
    top_pages,
)
from sessionscope.operators.seasonality import hourly_weekday_profile, weekly_sessions_orders
from sessionscope.operators.traffic import (
    conversion_by_device,
    conversion_rate,
    top_traffic_sources,
    weekly_session_trend,
    weekly_sessions_by_device,
)
from sessionscope.operators.variant import (
    variant_conversion,
    variant_launch,
    variant_sessions_orders,
)

__all__ = [
    "DEFAULT_STEPS",
    "FunnelStep",
    "bounce_markers",
    "bounce_rate",
    "bounce_rate_by_landing_page",
    "bounced_sessions",
    "channel_group",
    "classify_channel",
    "conversion_by_device",
    "conversion_by_device_source",
    "conversion_rate",
    "first_pageview_per_session",
    "funnel_counts",
    "funnel_pageview_flags",
    "funnel_rates",
    "hourly_weekday_profile",
    "landing_profile",
    "launch_pageview_id",
    "monthly_channel_mix",
    "page_launch",
    "session_first_pv_and_count",
    "session_funnel_flags",
    "session_landing_details",
    "sessions_with_landing_page",
    "source_mobile_share",
    "test_bounce_markers",
    "test_bounced_sessions",
    "test_first_pageviews",
    "test_landing_pages",
    "top_entry_pages",
    "top_pages",
    "top_traffic_sources",
    "variant_conversion",
    "variant_launch",
    "variant_sessions_orders",
    "weekly_bounce_trend",
    "weekly_session_trend",
    "weekly_sessions_by_device",
    "weekly_sessions_orders",
    "weekly_source_device_ratio",
    "weekly_sources",
]
