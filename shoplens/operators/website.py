"""Website-performance analyses: top and entry pages, bounce rates, landing
page tests, conversion funnels, page-version tests.

Pageviews are first reduced to session grain with plain aggregates (first
pageview id, pageview count, step flags as ``max``), which Spark
hash-aggregates and combines map-side; only then do they meet sessions or
orders, on the session id they are already partitioned by.  "Is the first page
X?" compares ids: the smallest id equals the smallest id of page X.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.calendar import day, year_week
from shoplens.functions.metrics import count_if, in_range, ratio
from shoplens.operators.common import SID, cohort, n_sessions, orders_per_session

PV = "website_pageview_id"
URL = "pageview_url"


def _sessions_of(pageviews: DataFrame) -> DataFrame:
    return pageviews.filter(F.col(SID).isNotNull())


def top_pages(pageviews: DataFrame, before) -> DataFrame:
    """Distinct sessions per URL, most first."""
    return (pageviews.filter(in_range("created_at", before=before))
            .groupBy(URL)
            .agg(F.countDistinct(SID).alias("sessions"))
            .orderBy(F.desc("sessions")))


def entry_pages(pageviews: DataFrame) -> DataFrame:
    """Sessions per landing page (URL of the session's first pageview).

    The smallest id of each session is a hash aggregate of two numbers; its
    pageview, and with it the URL, is looked up by that id."""
    first = _sessions_of(pageviews).groupBy(SID).agg(F.min(PV).alias(PV)).select(PV)
    return (pageviews.join(first, PV, "left_semi").groupBy(F.col(URL).alias("landing_page"))
            .agg(F.count(F.lit(1)).alias("sessions_hitting_this_lander")))


def bounce_rate(pageviews: DataFrame, before, landing: str = "/home") -> DataFrame:
    """Sessions whose first pageview before ``before`` is ``landing``, how
    many of them have exactly one pageview (counting all their pageviews),
    and the rate.  One row."""
    early = in_range("created_at", before=before)
    per = (_sessions_of(pageviews).groupBy(SID)
           .agg(F.min(F.when(early, F.col(PV))).alias("first"),
                F.min(F.when(early & (F.col(URL) == landing), F.col(PV))).alias("first_landing"),
                F.count(PV).alias("n_pv")))
    return (per.filter(F.col("first") == F.col("first_landing"))
            .agg(n_sessions().alias("total_sessions"),
                 count_if(F.col("n_pv") == 1).alias("bounced_sessions"))
            .withColumn("bounce_rate", ratio("bounced_sessions", "total_sessions")))


def first_seen(pageviews: DataFrame, url: str) -> DataFrame:
    """First time and first pageview id at which ``url`` was seen."""
    return (pageviews.filter((F.col(URL) == url) & F.col("created_at").isNotNull())
            .agg(F.min("created_at").alias("first_created_at"),
                 F.min(PV).alias("first_pageview_id")))


def first_seen_id(pageviews: DataFrame, url: str) -> DataFrame:
    """First pageview id of ``url``."""
    return pageviews.filter(F.col(URL) == url).agg(F.min(PV).alias("first_pageview_id"))


def _launch_id(pageviews: DataFrame, url: str):
    """The first pageview id of ``url`` as a scalar subquery: computed once
    inside the plan, no driver round trip."""
    return pageviews.filter(F.col(URL) == url).agg(F.min(PV)).scalar()


def landing_page_test(pageviews: DataFrame, sessions: DataFrame, before,
                      source: str, campaign: str,
                      pages: Sequence[str] = ("/home", "/lander-1"),
                      launch_url: str = "/lander-1", launch_inclusive: bool = False,
                      launch_id: int | None = None) -> DataFrame:
    """A/B test of landing pages since the launch of ``launch_url``.

    Per session of the channel cohort, the first pageview after the launch
    pageview id (strictly after unless ``launch_inclusive``) is its landing
    page; a session bounced if it has one pageview in all.  Per landing page
    in ``pages``: sessions, bounced sessions, bounce rate.  ``launch_id``
    fixes the launch pageview id instead of discovering it.
    """
    launch = F.lit(launch_id) if launch_id is not None else _launch_id(pageviews, launch_url)
    after_launch = (F.col(PV) >= launch) if launch_inclusive else (F.col(PV) > launch)
    pages = list(dict.fromkeys(pages))
    entry = F.when(F.col("after_launch"), F.col(PV))
    per = (_sessions_of(pageviews).withColumn("after_launch", after_launch)
           .groupBy(SID)
           .agg(F.min(entry).alias("first"),
                *[F.min(F.when(F.col(URL) == p, entry)).alias(f"first{i}") for i, p in enumerate(pages)],
                F.count(PV).alias("n_pv")))
    c = cohort(sessions, before=before, source=source, campaign=campaign).select(SID)
    landed = F.lit(None).cast("string")
    for i, p in enumerate(pages):
        landed = F.when(F.col("first") == F.col(f"first{i}"), F.lit(p)).otherwise(landed)
    return (per.join(c, SID, "left_semi")
            .withColumn("landing_page", landed).filter(F.col("landing_page").isNotNull())
            .groupBy("landing_page")
            .agg(n_sessions().alias("sessions"),
                 count_if(F.col("n_pv") == 1).alias("bounced_sessions"))
            .select("landing_page", "sessions", "bounced_sessions",
                    ratio("bounced_sessions", "sessions").alias("bounce_rate")))


#: Column label and URL of each landing page that is counted.
LANDING_PAGES = {"home": "/home", "lander": "/lander-1"}


def _weekly_landing(per_session: DataFrame, pages: Mapping[str, str]) -> DataFrame:
    first_ts = F.col("first_at")
    return (per_session.groupBy(year_week(first_ts).alias("year_week"))
            .agg(F.min(day(first_ts)).alias("week_start_date"),
                 n_sessions().alias("total_sessions"),
                 count_if(F.col("n_pv") == 1).alias("bounce_sessions"),
                 *[count_if(F.col("first") == F.col(f"first_{lab}")).alias(f"{lab}_sessions") for lab in pages])
            .select("year_week", "week_start_date", "total_sessions", "bounce_sessions",
                    ratio("bounce_sessions", "total_sessions").alias("bounce_rate"),
                    *[f"{lab}_sessions" for lab in pages]))


def _pageviews_per_session(pageviews: DataFrame, pages: Mapping[str, str]) -> DataFrame:
    return (_sessions_of(pageviews).groupBy(SID)
            .agg(F.min(PV).alias("first"), F.min_by("created_at", PV).alias("first_at"),
                 *[F.min(F.when(F.col(URL) == u, F.col(PV))).alias(f"first_{lab}") for lab, u in pages.items()],
                 F.count(PV).alias("n_pv")))


def weekly_landing_trend(sessions: DataFrame, pageviews: DataFrame, after, before,
                         source: str, campaign: str,
                         pages: Mapping[str, str] = LANDING_PAGES) -> DataFrame:
    """Per year-week of the session's first pageview: sessions of the
    channel cohort, bounces, bounce rate, and for each label of ``pages`` the
    sessions landing on its URL."""
    c = cohort(sessions, after=after, before=before, source=source, campaign=campaign).select(SID)
    per = c.join(_pageviews_per_session(pageviews, pages), SID, "left") \
        .withColumn("n_pv", F.coalesce("n_pv", F.lit(0)))
    return _weekly_landing(per, pages)


def weekly_landing_trend_raw(sessions: DataFrame, pageviews: DataFrame, after, before,
                             source: str, campaign: str,
                             pages: Mapping[str, str] = LANDING_PAGES) -> DataFrame:
    """As ``weekly_landing_trend`` but with the cohort predicate in the ON
    clause of the LEFT JOIN: every session of the table is kept, sessions
    outside the cohort get no pageviews and form a NULL week."""
    in_cohort = (in_range("created_at", after=after, before=before)
                 & (F.col("utm_source") == source) & (F.col("utm_campaign") == campaign))
    s = sessions.select(SID, in_cohort.alias("in_cohort"))
    per = _pageviews_per_session(pageviews, pages)
    j = s.join(per, (s[SID] == per[SID]) & s["in_cohort"], "left").select(
        s[SID], *[per[c] for c in per.columns if c not in (SID, "n_pv")],
        F.coalesce(per["n_pv"], F.lit(0)).alias("n_pv"))
    return _weekly_landing(j, pages)


def _step_flags(pageviews: DataFrame, steps: Mapping[str, str]) -> DataFrame:
    """One row per session that saw any step page: 1/0 per step."""
    url = F.col(URL)
    return (_sessions_of(pageviews).filter(url.isin(*steps.values()))
            .groupBy(SID)
            .agg(*[F.max((url == u).cast("int")).alias(label) for label, u in steps.items()]))


def open_funnel(sessions: DataFrame, pageviews: DataFrame, steps: Mapping[str, str],
                start, end) -> DataFrame:
    """Funnel over sessions (created in [start, end]) that saw any step
    page; a step counts if its page appears anywhere in the session.  One
    row: sessions, sessions reaching each later step, step-to-step rates."""
    labels = list(steps)
    c = cohort(sessions, start=start, end=end).select(SID)
    agg = (c.join(_step_flags(pageviews, steps), SID, "inner")
           .agg(n_sessions().alias("sessions"),
                *[count_if(F.col(lab) == 1).alias(f"to_{lab}") for lab in labels[1:]]))
    prev = "sessions"
    for lab in labels[1:]:
        agg = agg.withColumn(f"clicked_to_{lab}", ratio(f"to_{lab}", prev))
        prev = f"to_{lab}"
    return agg


def conversion_funnel(sessions: DataFrame, pageviews: DataFrame, steps: Mapping[str, str],
                      after, before, source: str, campaign: str,
                      entry_label: str = "lander") -> DataFrame:
    """Funnel over all sessions of the channel cohort (sessions without any
    step page count as reaching none).  One row: sessions, sessions reaching
    each step, and each step's click rate from the step before."""
    labels = list(steps)
    c = cohort(sessions, after=after, before=before, source=source, campaign=campaign).select(SID)
    agg = (c.join(_step_flags(pageviews, steps), SID, "left")
           .agg(n_sessions().alias("sessions"),
                *[count_if(F.col(lab) == 1).alias(f"to_{lab}") for lab in labels]))
    prev_count, prev_label = "sessions", entry_label
    for lab in labels:
        agg = agg.withColumn(f"{prev_label}_click_rt", ratio(f"to_{lab}", prev_count))
        prev_count, prev_label = f"to_{lab}", lab
    return agg


def page_version_order_test(pageviews: DataFrame, orders: DataFrame, before,
                            versions: Sequence[str] = ("/billing", "/billing-2"),
                            since_url: str | None = None, min_pv_id: int | None = None) -> DataFrame:
    """Per page version: sessions that saw it (from the first pageview of
    ``since_url``, default the last version, inclusive), their orders, and
    the order rate.  ``min_pv_id`` fixes that starting id instead.

    Pageviews reduce to one row per session with a seen-flag per version,
    which joins the per-session order counts on the shared partitioning.
    """
    since = F.lit(min_pv_id) if min_pv_id is not None else _launch_id(pageviews, since_url or versions[-1])
    url = F.col(URL)
    seen = (_sessions_of(pageviews)
            .filter((F.col(PV) >= since) & in_range("created_at", before=before) & url.isin(*versions))
            .groupBy(SID)
            .agg(*[F.max(url == v).alias(f"v{i}") for i, v in enumerate(versions)]))
    j = seen.join(orders_per_session(orders).select(SID, "n_orders"), SID, "left")
    totals = j.agg(*[a for i in range(len(versions)) for a in (
        count_if(F.col(f"v{i}")).alias(f"s{i}"),
        F.coalesce(F.sum(F.when(F.col(f"v{i}"), F.col("n_orders"))), F.lit(0)).cast("long").alias(f"o{i}"))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(v).alias("billing_version_seen"), F.col(f"s{i}").alias("sessions"),
                 F.col(f"o{i}").alias("orders"))
        for i, v in enumerate(versions)])).alias("r")
    return (totals.select(rows).select("r.*")
            .filter(F.col("sessions") > 0)
            .withColumn("billing_to_order_rt", ratio("orders", "sessions")))
