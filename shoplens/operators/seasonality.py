"""Seasonality and business-pattern analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.calendar import day, week_number, weekday
from shoplens.functions.metrics import half_up_avg_1
from shoplens.operators.common import SID, cohort, n_orders, n_sessions, with_orders

# Output column per weekday number (0 = Monday).
WEEKDAY_COLUMNS = ["mon", "tue", "wed", "thur", "fri", "sat", "sun"]


def monthly_volume(sessions: DataFrame, orders: DataFrame, before) -> DataFrame:
    """Per (year, month) of session start: sessions and orders."""
    s = cohort(sessions, before=before).select(SID, "created_at")
    return (with_orders(s, orders)
            .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
            .agg(n_sessions().alias("sessions"), n_orders().alias("orders")))


def weekly_volume(sessions: DataFrame, orders: DataFrame, before) -> DataFrame:
    """Per (year, week) of session start: first day, sessions, orders."""
    s = cohort(sessions, before=before).select(SID, "created_at")
    return (with_orders(s, orders)
            .groupBy(F.year("created_at").alias("year"), week_number("created_at").alias("week"))
            .agg(F.min(day("created_at")).alias("week_start"),
                 n_sessions().alias("sessions"), n_orders().alias("orders")))


def hour_weekday_grid(sessions: DataFrame, start, end) -> DataFrame:
    """Sessions per (date, hour), averaged per hour over all dates and per
    weekday; averages rounded half-up to one decimal.  Only (date, hour)
    cells with sessions are averaged."""
    cells = (cohort(sessions, start=start, end=end)
             .groupBy(day("created_at").alias("created_date"),
                      weekday("created_at").alias("week_day"),
                      F.hour("created_at").alias("hr"))
             .agg(n_sessions().alias("sessions")))
    wd, n = F.col("week_day"), F.col("sessions")
    parts = [F.sum(n).alias("t_all"), F.count(n).alias("n_all")]
    for i in range(7):
        parts += [F.sum(F.when(wd == i, n)).alias(f"t{i}"), F.count(F.when(wd == i, n)).alias(f"n{i}")]
    return (cells.groupBy("hr").agg(*parts)
            .select("hr", half_up_avg_1("t_all", "n_all").alias("avg_sessions"),
                    *[half_up_avg_1(f"t{i}", f"n{i}").alias(name)
                      for i, name in enumerate(WEEKDAY_COLUMNS)]))
