"""Channel-portfolio analyses: source mix, device mix, channel groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.calendar import day, year_week
from shoplens.functions.channels import channel_group, traffic_type
from shoplens.functions.metrics import count_if, ratio
from shoplens.operators.common import cohort, n_orders, n_sessions, with_orders


def weekly_source_pivot(sessions: DataFrame, after, before, campaign: str,
                        sources: Sequence[str] = ("gsearch", "bsearch")) -> DataFrame:
    """Per year-week: first day, all sessions and sessions per source."""
    src = F.col("utm_source")
    return (cohort(sessions, after=after, before=before, campaign=campaign)
            .groupBy(year_week("created_at").alias("year_week"))
            .agg(F.min(day("created_at")).alias("week_start_date"),
                 F.count("website_session_id").alias("total_sessions"),
                 *[count_if(src == s).alias(f"{s}_sessions") for s in sources]))


def mobile_share_by_source(sessions: DataFrame, after, before, campaign: str) -> DataFrame:
    """Per source: sessions, mobile sessions, mobile share."""
    return (cohort(sessions, after=after, before=before, campaign=campaign)
            .groupBy("utm_source")
            .agg(n_sessions().alias("sessions"),
                 count_if(F.col("device_type") == "mobile").alias("mobile_sessions"))
            .withColumn("mobile_percentage", ratio("mobile_sessions", "sessions")))


def conversion_by_device_source(sessions: DataFrame, orders: DataFrame, after, before,
                                campaign: str) -> DataFrame:
    """Per (device, source): sessions, orders, conversion rate."""
    s = cohort(sessions, after=after, before=before, campaign=campaign)
    return (with_orders(s.select("website_session_id", "device_type", "utm_source"), orders)
            .groupBy("device_type", "utm_source")
            .agg(n_sessions().alias("sessions"), n_orders().alias("orders"))
            .withColumn("conversion_rate", ratio("orders", "sessions")))


def weekly_source_device_pivot(sessions: DataFrame, after, before, campaign: str,
                               sources: Mapping[str, str] | None = None,
                               devices: Sequence[str] = ("desktop", "mobile")) -> DataFrame:
    """Per year-week: sessions of each (source, device) and, per device, every
    further source's sessions as a share of the first's.

    ``sources`` maps a column prefix to a utm_source, base source first.
    """
    sources = dict(sources or {"g": "gsearch", "b": "bsearch"})
    base, *others = sources
    src, dev = F.col("utm_source"), F.col("device_type")
    aggs, rates = [], []
    for d in devices:
        for p, s in sources.items():
            aggs.append(count_if((src == s) & (dev == d)).alias(f"{p}_{d}_sessions"))
        rates += [(f"{other}_percentage_of_{base}_{d}",
                   ratio(f"{other}_{d}_sessions", f"{base}_{d}_sessions")) for other in others]
    out = (cohort(sessions, after=after, before=before, campaign=campaign)
           .groupBy(year_week("created_at").alias("year_week"))
           .agg(F.min(day("created_at")).alias("week_start_date"), *aggs))
    for name, col in rates:
        out = out.withColumn(name, col)
    return out


def referrer_traffic_type(sessions: DataFrame) -> DataFrame:
    """Sessions by direct / organic-per-engine / others, most first."""
    return (sessions.groupBy(traffic_type().alias("type_of_traffic"))
            .agg(n_sessions().alias("sessions"))
            .orderBy(F.desc("sessions")))


def monthly_channel_group_mix(sessions: DataFrame, before) -> DataFrame:
    """Per (year, month): nonbrand, brand, direct and organic sessions and
    the last three as shares of nonbrand."""
    g = F.col("channel_group")
    return (cohort(sessions, before=before)
            .withColumn("channel_group", channel_group())
            .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
            .agg(count_if(g == "paid_nonbrand").alias("nonbrand"),
                 count_if(g == "paid_brand").alias("brand"),
                 count_if(g == "direct_type_in").alias("direct"),
                 count_if(g == "organic_search").alias("organic"))
            .select("year", "month", "nonbrand", "brand",
                    ratio("brand", "nonbrand").alias("brand_percent_of_nonbrand"),
                    "direct", ratio("direct", "nonbrand").alias("direct_percent_of_nonbrand"),
                    "organic", ratio("organic", "nonbrand").alias("organic_percent_of_nonbrand")))
