"""Traffic-source analyses: top sources, conversion, weekly trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.calendar import day, week_number
from shoplens.functions.metrics import count_if, id_range, ratio
from shoplens.operators.common import cohort, n_orders, n_sessions, with_orders


def top_traffic_sources(sessions: DataFrame, before) -> DataFrame:
    """Sessions per (utm_source, utm_campaign, http_referer), most first;
    NULLs form their own groups."""
    return (cohort(sessions, before=before)
            .groupBy("utm_source", "utm_campaign", "http_referer")
            .agg(n_sessions().alias("number_of_sessions"))
            .orderBy(F.desc("number_of_sessions")))


def conversion_overall(sessions: DataFrame, orders: DataFrame, before,
                       source: str, campaign: str) -> DataFrame:
    """One row: sessions, orders and session-to-order rate of a channel."""
    s = cohort(sessions, before=before, source=source, campaign=campaign)
    return (with_orders(s.select("website_session_id"), orders)
            .agg(n_sessions().alias("sessions"), n_orders().alias("orders"))
            .withColumn("session_to_order_conv_rt", ratio("orders", "sessions")))


def items_per_order_pivot(orders: DataFrame, id_lo: int | None = None, id_hi: int | None = None,
                          sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """Per primary product: orders with n items for each n, and all orders
    (optionally only order ids in [id_lo, id_hi])."""
    def name(n):
        return f"orders_with_{n}_item" + ("" if n == 1 else "s")
    return (orders.filter(id_range(id_lo, id_hi))
            .groupBy("primary_product_id")
            .agg(*[count_if(F.col("items_purchased") == n).alias(name(n)) for n in sizes],
                 F.count("order_id").alias("total_orders")))


def weekly_session_trend(sessions: DataFrame, before, source: str, campaign: str) -> DataFrame:
    """Per (year, week): first day seen and sessions of a channel."""
    return (cohort(sessions, before=before, source=source, campaign=campaign)
            .groupBy(F.year("created_at").alias("year"), week_number("created_at").alias("week_no"))
            .agg(F.min(day("created_at")).alias("week"), n_sessions().alias("sessions")))


def conversion_by_device(sessions: DataFrame, orders: DataFrame, before,
                         source: str, campaign: str) -> DataFrame:
    """Per device type: sessions, orders, conversion rate of a channel."""
    s = cohort(sessions, before=before, source=source, campaign=campaign)
    return (with_orders(s.select("website_session_id", "device_type"), orders)
            .groupBy("device_type")
            .agg(n_sessions().alias("sessions"), n_orders().alias("orders"))
            .withColumn("conversion_rt", ratio("orders", "sessions")))


def weekly_device_pivot(sessions: DataFrame, after, before, source: str, campaign: str,
                        devices: Sequence[str] = ("desktop", "mobile")) -> DataFrame:
    """Per (year, week): first day seen and sessions per device type."""
    dev = F.col("device_type")
    return (cohort(sessions, after=after, before=before, source=source, campaign=campaign)
            .groupBy(F.year("created_at").alias("year"), week_number("created_at").alias("week_no"))
            .agg(F.min(day("created_at")).alias("week"),
                 *[count_if(dev == d).alias(f"{d}_sessions") for d in devices]))
