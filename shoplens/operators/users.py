"""User-level analyses: repeat visitors, time to repeat, new vs repeat.

The "new" session of a user is the one with ``is_repeat_session = 0`` (in
the data model, the user's first session).  Joins between a user's repeat
sessions (the large side, possibly one hot user) and their first new session
split hot users over several tasks (``split_hot_join``); no join pairs a
user's new sessions with their repeat sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.channels import channel_group
from shoplens.functions.metrics import count_if, ratio, sum_money
from shoplens.operators.common import SID, cohort, n_orders, n_sessions, split_hot_join, with_orders


def _repeat():
    return F.col("is_repeat_session")


def repeat_session_histogram_sum(sessions: DataFrame, start, before) -> DataFrame:
    """Users with a new session in [start, before): per user, the sum of
    repeat flags of their window sessions (once per new session of the
    user, as a join from new sessions would give); users per value."""
    per_user = (cohort(sessions, start=start, before=before)
                .filter(F.col("user_id").isNotNull())
                .groupBy("user_id")
                .agg(count_if(_repeat() == 0).alias("n_new"),
                     F.sum("is_repeat_session").alias("repeat_flags")))
    return (per_user.filter(F.col("n_new") > 0)
            .groupBy((F.col("n_new") * F.col("repeat_flags")).alias("repeat_sessions"))
            .agg(F.count("user_id").alias("users"))
            .orderBy("repeat_sessions"))


def _new_and_repeat(sessions: DataFrame, start, before):
    w = cohort(sessions, start=start, before=before).filter(F.col("user_id").isNotNull())
    new = w.filter(_repeat() == 0).select("user_id", F.col(SID).alias("new_session_id"),
                                       F.col("created_at").alias("new_at"))
    rep = w.filter(_repeat() == 1).select("user_id", F.col(SID).alias("repeat_session_id"),
                                       F.col("created_at").alias("repeat_at"))
    return new, rep


def repeat_session_histogram(sessions: DataFrame, start, before, heavy: DataFrame | None = None) -> DataFrame:
    """Users with a new session in [start, before), by how many repeat
    sessions in the window came after (a larger id than) their first new
    session.  ``heavy``: the store's frequent users."""
    new, rep = _new_and_repeat(sessions, start, before)
    first_new = new.groupBy("user_id").agg(F.min("new_session_id").alias("new_session_id"))
    later = (split_hot_join(rep, first_new, ["user_id"], salt_by="repeat_session_id", heavy=heavy)
             .filter(F.col("repeat_session_id") > F.col("new_session_id"))
             .groupBy("user_id").agg(F.count("repeat_session_id").alias("n_rep")))
    per_user = first_new.join(later, "user_id", "left") \
        .select("user_id", F.coalesce("n_rep", F.lit(0)).alias("repeat_sessions"))
    return per_user.groupBy("repeat_sessions").agg(F.count("user_id").alias("users"))


#: Session ids per bucket of a user in ``time_to_repeat``: bounds a window's rows.
ID_BUCKET = 1_000_000


def time_to_repeat(sessions: DataFrame, start, before, id_bucket: int = ID_BUCKET) -> DataFrame:
    """Days from a new session to the user's next repeat session (first by
    time among later ids) in [start, before); average, min and max over new
    sessions that have one.  One row.

    The next repeat is a running minimum from a user's largest id down.  It
    runs over id buckets: inside a bucket over its rows (ids are unique, so
    at most ``id_bucket``), across buckets over one row per bucket.
    """
    bucket = F.floor(F.col(SID) / F.lit(id_bucket)).cast("long")
    rep_at = F.when(_repeat() == 1, F.col("created_at"))
    w = (cohort(sessions, start=start, before=before).filter(F.col("user_id").isNotNull())
         .select("user_id", SID, "created_at", "is_repeat_session", rep_at.alias("rep_at"), bucket.alias("bucket")))
    later = Window.partitionBy("user_id", "bucket").orderBy(F.desc(SID)).rowsBetween(Window.unboundedPreceding, -1)
    inside = w.withColumn("next_here", F.min("rep_at").over(later)).filter(_repeat() == 0)
    beyond = Window.partitionBy("user_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (w.groupBy("user_id", "bucket").agg(F.min("rep_at").alias("least"))
               .withColumn("next_beyond", F.min("least").over(beyond)).drop("least"))
    second = F.least("next_here", "next_beyond")  # ignores the NULL one
    days = F.datediff(F.to_date(second), F.to_date("created_at"))
    return (inside.join(carried, ["user_id", "bucket"]).select(days.alias("d"))
            .agg(ratio(F.sum("d"), F.count("d")).alias("avg_days_first_to_second"),
                 F.min("d").alias("min_days_first_to_second"),
                 F.max("d").alias("max_days_first_to_second")))


def channel_new_vs_repeat(sessions: DataFrame, start, before) -> DataFrame:
    """Per channel group (incl. paid social): new and repeat sessions,
    most repeat sessions first."""
    return (cohort(sessions, start=start, before=before)
            .groupBy(channel_group(with_social=True).alias("channel_group"))
            .agg(count_if(_repeat() == 0).alias("new_sessions"),
                 count_if(_repeat() == 1).alias("repeat_sessions"))
            .orderBy(F.desc("repeat_sessions")))


def new_vs_repeat_conversion(sessions: DataFrame, orders: DataFrame, start, before) -> DataFrame:
    """Per repeat flag: sessions, conversion rate, revenue per session."""
    s = cohort(sessions, start=start, before=before).select(SID, "is_repeat_session")
    return (with_orders(s, orders)
            .groupBy("is_repeat_session")
            .agg(n_sessions().alias("sessions"), n_orders().alias("orders"),
                 sum_money("revenue").alias("revenue"))
            .select("is_repeat_session", "sessions",
                    ratio("orders", "sessions").alias("conv_rate"),
                    ratio("revenue", "sessions").alias("rev_per_session")))
