"""Catalog entries: seasonality (S1-S3) and user level (U1-U5)."""

from shoplens.operators import seasonality, users
from shoplens.plans.catalog import Analysis, mo, register, rt, week, yr

WIN = "created_at < TIMESTAMP '{before}' AND created_at >= TIMESTAMP '{start}'"
SWIN = "s.created_at < TIMESTAMP '{before}' AND s.created_at >= TIMESTAMP '{start}'"


_DAYS = ["mon", "tue", "wed", "thur", "fri", "sat", "sun"]


def _per_day(cond: str) -> str:
    """Sessions per day that has any, rounded half-up to one decimal on integers."""
    n, d = f"COUNT(*) FILTER ({cond})", f"COUNT(DISTINCT created_at::DATE) FILTER ({cond})"
    return f"CASE WHEN {n} > 0 THEN CAST((20 * {n} + {d}) // (2 * {d}) AS DOUBLE) / 10.0 END"


def _grid_sql(p):
    days = ", ".join(f"{_per_day(f'isodow(created_at) = {i}')} AS {d}" for i, d in enumerate(_DAYS, 1))
    return f"""
SELECT CAST(hour(created_at) AS INTEGER) AS hr, {_per_day("TRUE")} AS avg_sessions, {days}
FROM website_sessions
WHERE created_at BETWEEN TIMESTAMP '{p["start"]}' AND TIMESTAMP '{p["end"]}'
GROUP BY 1"""


register(
    Analysis(
        "monthly_volume", "S1",
        lambda st, **p: seasonality.monthly_volume(st.sessions, st.web_orders, **p),
        dict(before="2024-01-25"),
        f"""
SELECT {yr("s.created_at")} AS year, {mo("s.created_at")} AS month,
       COUNT(DISTINCT s.website_session_id) AS sessions,
       COUNT(DISTINCT o.order_id) AS orders
FROM website_sessions s
LEFT JOIN web_orders o ON s.website_session_id = o.website_session_id
WHERE s.created_at < TIMESTAMP '{{before}}'
GROUP BY 1, 2"""),
    Analysis(
        "weekly_volume", "S2",
        lambda st, **p: seasonality.weekly_volume(st.sessions, st.web_orders, **p),
        dict(before="2024-01-25"),
        f"""
SELECT {yr("s.created_at")} AS year, {week("s.created_at")} AS week,
       MIN(CAST(s.created_at AS DATE)) AS week_start,
       COUNT(DISTINCT s.website_session_id) AS sessions,
       COUNT(DISTINCT o.order_id) AS orders
FROM website_sessions s
LEFT JOIN web_orders o ON s.website_session_id = o.website_session_id
WHERE s.created_at < TIMESTAMP '{{before}}'
GROUP BY 1, 2"""),
    Analysis(
        "hour_weekday_grid", "S3",
        lambda st, **p: seasonality.hour_weekday_grid(st.sessions, **p),
        dict(start="2024-01-05", end="2024-01-25"),
        _grid_sql),
    Analysis(
        "repeat_session_histogram_sum", "U1",
        lambda st, **p: users.repeat_session_histogram_sum(st.sessions, **p),
        dict(start="2024-01-01", before="2024-01-25"),
        f"""
SELECT repeat_sessions, COUNT(*) AS users
FROM (SELECT CAST(COUNT(*) FILTER (is_repeat_session = 0) * SUM(is_repeat_session) AS BIGINT) AS repeat_sessions
      FROM website_sessions
      WHERE {WIN} AND user_id IS NOT NULL
      GROUP BY user_id
      HAVING bool_or(is_repeat_session = 0))
GROUP BY ALL
ORDER BY 1"""),
    Analysis(
        "repeat_session_histogram", "U2",
        lambda st, **p: users.repeat_session_histogram(st.sessions, heavy=st.heavy("website_sessions"), **p),
        dict(start="2024-01-01", before="2024-01-25"),
        f"""
SELECT repeat_sessions, COUNT(*) AS users
FROM (SELECT user_id, COUNT(*) FILTER (is_repeat_session = 1 AND website_session_id > first_new) AS repeat_sessions
      FROM (SELECT *, MIN(website_session_id) FILTER (is_repeat_session = 0) OVER (PARTITION BY user_id) AS first_new
            FROM website_sessions WHERE {WIN} AND user_id IS NOT NULL)
      WHERE first_new IS NOT NULL
      GROUP BY ALL)
GROUP BY ALL"""),
    Analysis(
        "time_to_repeat", "U3",
        lambda st, **p: users.time_to_repeat(st.sessions, **p),
        dict(start="2024-01-01", before="2024-01-25"),
        f"""
SELECT AVG(days) AS avg_days_first_to_second,
       CAST(MIN(days) AS INTEGER) AS min_days_first_to_second,
       CAST(MAX(days) AS INTEGER) AS max_days_first_to_second
FROM (SELECT is_repeat_session,
             MIN(created_at) FILTER (is_repeat_session = 1)
               OVER (PARTITION BY user_id ORDER BY website_session_id
                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::DATE - created_at::DATE AS days
      FROM website_sessions WHERE {WIN} AND user_id IS NOT NULL)
WHERE is_repeat_session = 0"""),
    Analysis(
        "channel_new_vs_repeat", "U4",
        lambda st, **p: users.channel_new_vs_repeat(st.sessions, **p),
        dict(start="2024-01-01", before="2024-01-28"),
        f"""
rules(priority, label, campaign, source, no_source, referer) AS (
  VALUES (1, 'organic_search', NULL, NULL, TRUE, 'https://www.gsearch.com'),
         (1, 'organic_search', NULL, NULL, TRUE, 'https://www.bsearch.com'),
         (2, 'paid_nonbrand', 'nonbrand', NULL, FALSE, NULL),
         (3, 'paid_brand', 'brand', NULL, FALSE, NULL),
         (4, 'direct_type_in', NULL, NULL, TRUE, '(none)'),
         (5, 'paid_social', NULL, 'socialbook', FALSE, NULL)),
kinds AS (
  SELECT utm_source, utm_campaign, COALESCE(http_referer, '(none)') AS referer,
         COUNT(*) FILTER (is_repeat_session = 0) AS new_ones, COUNT(*) FILTER (is_repeat_session = 1) AS repeats
  FROM website_sessions
  WHERE {WIN}
  GROUP BY ALL),
named AS (
  SELECT (SELECT arg_min(r.label, r.priority) FROM rules r
          WHERE COALESCE(r.campaign = k.utm_campaign, r.campaign IS NULL) AND COALESCE(r.source = k.utm_source, r.source IS NULL)
            AND (k.utm_source IS NULL OR NOT r.no_source) AND COALESCE(r.referer = k.referer, TRUE)) AS channel_group,
         new_ones, repeats
  FROM kinds k)
SELECT channel_group, CAST(SUM(new_ones) AS BIGINT) AS new_sessions, CAST(SUM(repeats) AS BIGINT) AS repeat_sessions
FROM named
GROUP BY channel_group
ORDER BY repeat_sessions DESC"""),
    Analysis(
        "new_vs_repeat_conversion", "U5",
        lambda st, **p: users.new_vs_repeat_conversion(st.sessions, st.web_orders, **p),
        dict(start="2024-01-01", before="2024-01-28"),
        f"""
SELECT s.is_repeat_session,
       COUNT(DISTINCT s.website_session_id) AS sessions,
       {rt("COUNT(DISTINCT o.order_id)", "COUNT(DISTINCT s.website_session_id)")} AS conv_rate,
       {rt("SUM(o.price_usd)", "COUNT(DISTINCT s.website_session_id)")} AS rev_per_session
FROM website_sessions s
LEFT JOIN web_orders o ON s.website_session_id = o.website_session_id
WHERE {SWIN}
GROUP BY 1"""),
)
