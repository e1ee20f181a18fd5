"""Building blocks shared by the analyses.

Contract on inputs: ids are primary keys (one row per
``website_session_id`` in sessions, per ``order_id`` in orders, per
``order_item_id`` in items, per ``order_item_refund_id`` in refunds).  With
that, ``COUNT(DISTINCT id)`` over a join that does not fan out is a plain
count, and orders are summarised to session grain *before* they meet
sessions, so no join multiplies rows and no distinct aggregate is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.metrics import in_range

SID = "website_session_id"


def cohort(sessions: DataFrame, *, after=None, before=None, start=None, end=None,
           source: str | None = None, campaign: str | None = None) -> DataFrame:
    """Sessions in a time window, optionally of one utm source / campaign."""
    cond = in_range("created_at", after=after, before=before, start=start, end=end)
    if source is not None:
        cond = cond & (F.col("utm_source") == source)
    if campaign is not None:
        cond = cond & (F.col("utm_campaign") == campaign)
    return sessions.filter(cond)


def orders_per_session(orders: DataFrame) -> DataFrame:
    """One row per session that has orders: order count, revenue, units.

    Partial aggregation combines a hot session map-side; the result is
    hash-partitioned on the session id, which the following join reuses.
    """
    return (orders.filter(F.col(SID).isNotNull())
            .groupBy(SID)
            .agg(F.count("order_id").alias("n_orders"),
                 F.sum("price_usd").alias("revenue"),
                 F.sum("items_purchased").alias("units")))


def with_orders(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions LEFT JOIN their order summary (exactly one row per session)."""
    return sessions.join(orders_per_session(orders), SID, "left")


def n_orders() -> Column:
    """``COUNT(DISTINCT order_id)`` over sessions joined with orders."""
    return F.coalesce(F.sum("n_orders"), F.lit(0)).cast("long")


def n_sessions() -> Column:
    return F.count(SID)


# --- hot keys ----------------------------------------------------------------------
# Joins between a large side (pageviews of a session, repeat sessions of a
# user) and a side with one or a few rows per key cannot rely on AQE's skew
# split when the small side is an aggregate already partitioned on the key.
# ``split_hot_join`` salts only the hot keys: their large-side rows spread
# over ``n_split`` tasks, their few small-side rows are copied ``n_split``
# times.  Hot keys are told by the sketches stored with a table, or estimated
# from a sample; an estimate only moves rows between tasks, never changes the
# result.

HOT_ROWS_CONF = "spark.shoplens.hotKeyRows"        # rows per task before a key is split
HOT_SAMPLE_CONF = "spark.shoplens.hotKeySample"    # sampled fraction for the estimate
HOT_ROWS_DEFAULT, HOT_SAMPLE_DEFAULT = 4_000_000, 0.0001  # a hot key shows ~400 sampled rows


def _conf(df: DataFrame, key: str, default: float) -> float:
    try:
        return float(df.sparkSession.conf.get(key, str(default)))
    except Exception:
        return default


def hot_keys(big: DataFrame, keys: list[str], by: str | None, heavy: DataFrame | None = None) -> DataFrame:
    """Keys of ``big`` estimated to hold more than the per-task row budget,
    with ``n_split`` ways to split each.  The sample is chosen by a hash of
    ``by`` (the primary key), so it is a function of the rows and every scan
    of them finds the same keys; without a primary key (None) it is random,
    for callers that write the result.  With ``heavy`` (keys and their
    ``rows``, at least those of ``big``) nothing is scanned."""
    rows = _conf(big, HOT_ROWS_CONF, HOT_ROWS_DEFAULT)
    if heavy is not None:
        return (heavy.filter(F.col("rows") > rows)
                .select(*keys, F.ceil(F.col("rows") / F.lit(rows)).cast("int").alias("n_split")))
    frac = min(1.0, _conf(big, HOT_SAMPLE_CONF, HOT_SAMPLE_DEFAULT))
    million = 1_000_000
    chance = F.xxhash64(F.col(by)) if by else F.floor(F.rand() * million)
    picked = F.pmod(chance, F.lit(million)) < max(1, round(frac * million))
    sampled = big.filter(picked).select(*keys) if frac < 1 else big.select(*keys)
    return (sampled.groupBy(*keys).count()
            .select(*keys, F.ceil(F.col("count") / F.lit(frac * rows)).cast("int").alias("n_split"))
            .filter(F.col("n_split") > 1))


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be NULL (NULL meets NULL); keeps a's keys."""
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    rest = [F.col(f"y.{c}") for c in b.columns if c not in keys]
    return x.join(y, on, how).select(*[F.col(f"x.{c}") for c in a.columns], *rest)


def split_hot_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: str,
                   heavy: DataFrame | None = None) -> DataFrame:
    """Inner join of ``big`` (possibly hot keys) with ``small`` (a few rows
    per key) on ``keys``, with hot keys split over several tasks."""
    hot = hot_keys(big, keys, by=salt_by, heavy=heavy)
    b = (big.join(hot, keys, "left")
         .withColumn("_salt", F.when(F.col("n_split").isNull(), F.lit(0))
                     .otherwise(F.pmod(F.xxhash64(F.col(salt_by)), F.col("n_split"))).cast("int"))
         .drop("n_split"))
    s = (small.join(hot, keys, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_split"), F.lit(1)) - 1)))
         .drop("n_split"))
    return b.join(s, keys + ["_salt"], "inner").drop("_salt")


# --- lower bounds on ids -------------------------------------------------------------

def from_first(pageviews: DataFrame, seen: Column, pv: str = "website_pageview_id") -> DataFrame:
    """The pageviews whose id is at least the smallest id among those that
    satisfy ``seen`` (none if none does).  Analyses of what follows a view
    need no earlier id; the bound is a scalar subquery, so it is pushed to
    the scan as a filter on the id without a driver round trip."""
    least = pageviews.filter(seen).agg(F.min(pv)).scalar()
    return pageviews.filter(F.col(pv) >= least)
