"""Feeds: derive the five logical tables from the driver's parquet tables.

Web feed (from ``events``): a session is a per-user run of events, ordered by
``(ts, event_id)``, in which consecutive events are at most ``gap`` apart.

Sessionizing with one window per user would send a hot user (a third of all
events) to a single task.  Instead the window is keyed by
``(user_id, time bucket)`` and the state that crosses bucket borders (the
last timestamp before the bucket, the last session start before the bucket)
is carried by a per-(user, bucket) summary: one row per non-empty bucket, so
its size is bounded by the time span, not by the number of events.

Commerce feed (from ``orders`` and ``lineitem``): items numbered within their
order, orders enriched with their item count and primary product, refunds for
returned lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.operators.common import hot_keys, null_safe_join
from shoplens.operators.ranking import kept, number_rows, rank_in_key

# ---------------------------------------------------------------------------
# Fixed values of the test feeds (FIXTURES.md §2).  They must stay exactly as
# written for results to agree with the SQL oracle.
# ---------------------------------------------------------------------------
SESSION_GAP = "INTERVAL 12 HOURS"
# Channel of a session by the ``k`` of its first event:
# (k from, k to inclusive, utm_source, utm_campaign, http_referer)
CHANNEL_BANDS = [
    (0, 29, "gsearch", "nonbrand", "https://www.gsearch.com"),
    (30, 39, "gsearch", "brand", "https://www.gsearch.com"),
    (40, 54, "bsearch", "nonbrand", "https://www.bsearch.com"),
    (55, 59, "bsearch", "brand", "https://www.bsearch.com"),
    (60, 69, "socialbook", "pilot", "https://www.socialbook.com"),
    (70, 79, None, None, "https://www.gsearch.com"),
    (80, 89, None, None, "https://www.bsearch.com"),
    (90, 99, None, None, None),
]
# First page of a session by k % 3; later pages by event type.
LANDING_BY_K_MOD_3 = ["/home", "/lander-1", "/lander-2"]
CLICK_PAGE = "/products"
VIEW_PAGE_K_EVEN = "/the-original-mr-fuzzy"
VIEW_PAGE_K_ODD = "/the-forever-love-bear"
SIGNUP_PAGE = "/cart"
ERROR_PAGE_BY_K_MOD_3 = ["/shipping", "/billing", "/billing-2"]
PURCHASE_PAGE = "/thank-you-for-your-order"
WEB_COGS_RATE = Decimal("0.40")
STORE_COGS_RATE = Decimal("0.60")
RETURNED_FLAG = "R"
DOUBLE_REFUND_LINE = 7          # lines with this number get two refunds
ITEM_ID_FACTOR = 1_000_000      # order_item_id = order_id * 1,000,000 + line rank
REFUND_ID_FACTOR = 10           # refund id = order_item_id * 10 + j (- j below 0)


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] as a CASE chain (index is a small non-negative int)."""
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v))
    return out


def _band(k: Column, pos: int) -> Column:
    out = None
    for lo, hi, *vals in CHANNEL_BANDS:
        cond = k.between(lo, hi)
        val = F.lit(vals[pos]).cast("string")
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


@dataclass
class WebFeed:
    sessions: DataFrame
    pageviews: DataFrame
    orders: DataFrame
    tagged: DataFrame  # one row per event with its session id (for reuse)


def tag_sessions(events: DataFrame, bucket_hours: int = 1, state: DataFrame | None = None) -> DataFrame:
    """Events with ``session_id``, ``is_start`` and ``is_repeat``.

    With the ``state`` that earlier events left (``user_state``), events after
    them go on from there, as if all had been tagged together.

    ``session_id`` is the event_id of the session's first event;
    ``is_repeat`` marks a session start that has an earlier event of the same
    user (so the user's session ordinal is > 1).

    One window pass per (user, bucket) settles every row except each
    bucket's first; a per-bucket summary (one row per non-empty bucket)
    carries the last timestamp and the last session start across buckets and
    is joined back once.

    Buckets are ``bucket_hours`` wide; a (user, bucket) cell estimated to
    exceed the per-task row budget (``hot_keys``) is cut into one-second
    buckets instead.  Any bucketing that is monotone in time per user gives
    the same sessions, so this only moves work between tasks.  The carry runs
    in two levels, so that no task holds a user's seconds: over the buckets of
    a coarse cell, then over a user's coarse cells.

    Events without a user are one group, as a window treats them.
    """
    hour = F.unix_date(F.to_date("ts")).cast("long") * 24 + F.hour("ts")
    ev = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(hour / F.lit(bucket_hours)).cast("long").alias("coarse"),
        ((hour % bucket_hours) * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("offset"),
    )
    hot = hot_keys(ev, ["user_id", "coarse"], by="event_id")
    ev = (null_safe_join(ev, hot, ["user_id", "coarse"], "left")
          .select("event_id", "ts", "user_id", "event_type", "value", "k", "coarse",
                  (F.col("coarse") * (bucket_hours * 3600)
                   + F.when(F.col("n_split").isNotNull(), F.col("offset")).otherwise(0)).alias("bucket")))
    cell, key = ["user_id", "coarse"], ["user_id", "coarse", "bucket"]
    gap = F.expr(SESSION_GAP)
    in_bucket = Window.partitionBy(*key).orderBy("ts", "event_id")
    upto_row = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("rn") == 1

    # Pass 1, inside (user, bucket): a row other than the bucket's first
    # starts a session iff it is more than the gap after the row before it.
    w = (ev.withColumn("rn", F.row_number().over(in_bucket))
         .withColumn("local_start", F.col("ts") > F.lag("ts").over(in_bucket) + gap)
         .withColumn("in_sid", F.last(F.when(F.col("local_start"), F.col("event_id")),
                                      ignorenulls=True).over(upto_row)))

    # Bucket summary.  Starts of a user have strictly increasing ts, so the
    # last local start is a max_by on ts (fixed-width buffers, hash agg).
    summary = w.groupBy(*key).agg(
        F.max(F.when(first, F.col("ts"))).alias("first_ts"),
        F.max(F.when(first, F.col("event_id"))).alias("first_id"),
        F.max("ts").alias("last_ts"),
        F.max_by("event_id", F.when(F.col("local_start"), F.col("ts"))).alias("last_local_start"))

    # Level 1: the buckets of a coarse cell; only its first bucket is open.
    by_bucket = Window.partitionBy(*cell).orderBy("bucket")
    fine = (summary.withColumn("fine_ts", F.lag("last_ts").over(by_bucket))
            .withColumn("known_start", F.coalesce("last_local_start", F.when(
                F.col("first_ts") > F.col("fine_ts") + gap, F.col("first_id")))))
    opens = F.col("fine_ts").isNull()
    # Level 2: one row per coarse cell of a user.
    cells = fine.groupBy(*cell).agg(
        F.max(F.when(opens, F.col("first_ts"))).alias("cell_ts"),
        F.max(F.when(opens, F.col("first_id"))).alias("cell_id"),
        F.max("last_ts").alias("cell_last_ts"),
        F.max_by("known_start", F.when(F.col("known_start").isNotNull(), F.col("bucket"))).alias("cell_known"))
    by_cell = Window.partitionBy("user_id").orderBy("coarse")
    cells = cells.withColumn("cell_carry_ts", F.lag("cell_last_ts").over(by_cell))
    if state is None:
        cells = cells.withColumn("last_session", F.lit(None).cast("long"))
    else:  # what a user's first cell carries over
        cells = null_safe_join(cells, state, ["user_id"], "left").withColumn(
            "cell_carry_ts", F.coalesce("cell_carry_ts", "last_ts"))
    cells = (cells.withColumn("cell_starts", F.col("cell_carry_ts").isNull()
                         | (F.col("cell_ts") > F.col("cell_carry_ts") + gap))
             .withColumn("cell_start", F.coalesce("cell_known", F.when(F.col("cell_starts"), F.col("cell_id"))))
             .withColumn("cell_carry_sid", F.coalesce(F.last("cell_start", ignorenulls=True).over(
                 by_cell.rowsBetween(Window.unboundedPreceding, -1)), "last_session"))
             .select(*cell, "cell_carry_ts", "cell_starts", "cell_carry_sid"))
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    carry = (null_safe_join(fine, cells, cell, "left")
             .withColumn("carry_ts", F.coalesce("fine_ts", "cell_carry_ts"))
             .withColumn("first_is_start", F.when(opens, F.col("cell_starts"))
                         .otherwise(F.col("first_ts") > F.col("fine_ts") + gap))
             .withColumn("bucket_last_start", F.coalesce(
                 "last_local_start", F.when(F.col("first_is_start"), F.col("first_id"))))
             .withColumn("carry_sid", F.coalesce(
                 F.last("bucket_last_start", ignorenulls=True).over(before), "cell_carry_sid"))
             .select(*key, "carry_ts", "first_is_start", "first_id", "carry_sid"))

    return (
        null_safe_join(w, carry, key, "left")
        .withColumn("is_start", F.when(first, F.col("first_is_start"))
                    .otherwise(F.coalesce("local_start", F.lit(False))))
        .withColumn("is_repeat", F.when(first, F.col("carry_ts").isNotNull()).otherwise(True))
        .withColumn("session_id", F.coalesce(
            "in_sid", F.when(F.col("first_is_start"), F.col("first_id")), "carry_sid"))
        .drop("rn", "local_start", "in_sid", "carry_ts", "first_is_start", "first_id",
              "carry_sid", "bucket", "coarse")
    )


def user_state(tagged: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What later events need of the tagged ones: per user the last time and the
    session of the events then (events of one time are in one session);
    ``before`` is the state that the tagging began with."""
    new = tagged.select("user_id", F.col("ts").alias("last_ts"), F.col("session_id").alias("last_session"))
    rows = new if before is None else new.unionByName(before)
    return rows.groupBy("user_id").agg(F.max("last_ts").alias("latest"), F.max_by("last_session", "last_ts").alias("last_session")) \
        .select("user_id", F.col("latest").alias("last_ts"), "last_session")


def goes_on(events: DataFrame, state: DataFrame) -> bool:
    """Whether each event is later than all its user's events before."""
    late = null_safe_join(events.groupBy("user_id").agg(F.min("ts").alias("first_ts")), state, ["user_id"], "inner")
    return late.where(F.col("first_ts") <= F.col("last_ts")).isEmpty()


def web_feed(events: DataFrame, bucket_hours: int = 1) -> WebFeed:
    return web_tables_from_tagged(tag_sessions(events, bucket_hours))


def web_tables_from_tagged(t: DataFrame) -> WebFeed:
    """Sessions, pageviews and orders from events tagged with their session.
    Every purchase event is an order, so a session may have several."""
    k = F.col("k")
    sessions = t.filter("is_start").select(
        F.col("event_id").alias("website_session_id"),
        F.col("ts").alias("created_at"),
        "user_id",
        F.col("is_repeat").cast("int").alias("is_repeat_session"),
        _band(k, 0).alias("utm_source"),
        _band(k, 1).alias("utm_campaign"),
        _band(k, 2).alias("http_referer"),
        F.when(F.col("event_id") % 3 == 0, "mobile").otherwise("desktop").alias("device_type"),
    )
    etype = F.col("event_type")
    url = (
        F.when(F.col("is_start"), _pick(k % 3, LANDING_BY_K_MOD_3))
        .when(etype == "click", F.lit(CLICK_PAGE))
        .when(etype == "view", F.when(k % 2 == 0, VIEW_PAGE_K_EVEN).otherwise(VIEW_PAGE_K_ODD))
        .when(etype == "signup", F.lit(SIGNUP_PAGE))
        .when(etype == "error", _pick(k % 3, ERROR_PAGE_BY_K_MOD_3))
        .when(etype == "purchase", F.lit(PURCHASE_PAGE))
    )
    pageviews = t.select(
        F.col("event_id").alias("website_pageview_id"),
        F.col("ts").alias("created_at"),
        F.col("session_id").alias("website_session_id"),
        url.alias("pageview_url"),
    )
    purchases = t.filter(etype == "purchase")
    price = F.col("value").cast("decimal(12,2)")
    orders = purchases.select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("created_at"),
        F.col("session_id").alias("website_session_id"),
        (F.col("k") % 4 + 1).cast("int").alias("primary_product_id"),
        F.when(F.col("k") % 3 == 0, 2).otherwise(1).cast("int").alias("items_purchased"),
        price.alias("price_usd"),
        (price * F.lit(WEB_COGS_RATE)).cast("decimal(16,4)").alias("cogs_usd"),
    )
    return WebFeed(sessions, pageviews, orders, t)


@dataclass
class CommerceFeed:
    orders: DataFrame
    order_items: DataFrame
    refunds: DataFrame
    lines: DataFrame  # numbered line items the three tables derive from (for reuse)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
#: Order keys up to this have item and refund ids by the formula.
LAST_PLAIN_ORDER = (2**63 - 1) // (ITEM_ID_FACTOR * REFUND_ID_FACTOR) - 1


def number_lines(lineitem: DataFrame) -> DataFrame:
    """Line items numbered within their order, in the item table's columns
    plus the two that refunds need.

    An order of any length will do: lines of an order beyond a task's row
    budget are ranked by range (``rank_in_key``).  Item ids come from the order
    key and the rank; lines that the formula has no room for (ranks from
    ITEM_ID_FACTOR on, order keys below 0 or beyond LAST_PLAIN_ORDER, none at
    all) are numbered -1, -2, ... in the order of their keys and ranks."""
    plain_key = F.col("l_orderkey").between(0, LAST_PLAIN_ORDER)
    # a row per order meets one task as three numbers
    odd = (lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
           .where(~F.coalesce(plain_key, F.lit(False)) | (F.col("lines") >= ITEM_ID_FACTOR)))
    li = rank_in_key(lineitem.select(*LINE_COLUMNS), ["l_orderkey"], LINE_ORDER, "rn")
    by_formula = F.col("l_orderkey") * ITEM_ID_FACTOR + F.col("rn")
    if odd.isEmpty():
        li = li.withColumn("order_item_id", by_formula)
    else:
        li = kept(li, "ranked-lines")
        plain = F.coalesce(plain_key & (F.col("rn") < ITEM_ID_FACTOR), F.lit(False))
        others = number_rows(li.where(~plain), ["l_orderkey", "rn"], "number")
        li = (li.where(plain).withColumn("order_item_id", by_formula)
              .unionByName(others.withColumn("order_item_id", -F.col("number")).drop("number")))
    return li.select(
        "order_item_id",
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("product_id"),
        (F.col("rn") == 1).cast("int").alias("is_primary_item"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price_usd"),
        F.col("l_shipdate").alias("created_at"),
        "l_returnflag", "l_linenumber",
    )


def commerce_feed(orders: DataFrame, lineitem: DataFrame) -> CommerceFeed:
    return commerce_tables(orders, number_lines(lineitem))


def commerce_tables(orders: DataFrame, items_x: DataFrame) -> CommerceFeed:
    """Orders, items and refunds from the source orders and numbered lines."""
    order_items = items_x.drop("l_returnflag", "l_linenumber")

    per_order = order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).cast("int").alias("items_purchased"),
        F.max(F.when(F.col("is_primary_item") == 1, F.col("product_id"))).alias("primary_product_id"),
    )
    price = F.col("o_totalprice").cast("decimal(12,2)")
    store_orders = (
        orders.select("o_orderkey", "o_orderdate", "o_totalprice")
        .join(per_order, F.col("o_orderkey") == F.col("order_id"), "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("created_at"),
            F.lit(None).cast("long").alias("website_session_id"),
            F.col("primary_product_id").cast("int").alias("primary_product_id"),
            F.coalesce("items_purchased", F.lit(0)).cast("int").alias("items_purchased"),
            price.alias("price_usd"),
            (price * F.lit(STORE_COGS_RATE)).cast("decimal(16,4)").alias("cogs_usd"),
        )
    )

    copies = F.when(F.col("l_linenumber") == DOUBLE_REFUND_LINE, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    refunds = (
        items_x.filter(F.col("l_returnflag") == RETURNED_FLAG)
        .select("*", F.explode(copies).alias("j"))
        .select(
            (F.col("order_item_id") * REFUND_ID_FACTOR + F.when(F.col("order_item_id") < 0, -F.col("j"))
             .otherwise(F.col("j"))).alias("order_item_refund_id"),
            "order_item_id",
            F.col("price_usd").alias("refund_amount_usd"),
            F.timestamp_add("DAY", F.col("l_linenumber"), F.col("created_at")).alias("created_at"),
        )
    )
    return CommerceFeed(store_orders, order_items, refunds, items_x)
