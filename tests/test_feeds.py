"""Feeds: the skew-safe sessionization equals a plain per-user window
(DuckDB), does not depend on its bucket size, and handles gap edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from samples import SF_SMALL
from shoplens.plans.oracle_feeds import with_feeds
from shoplens.plans.verify import compare, duck
from shoplens.operators import ranking
from shoplens.sources import feeds
from shoplens.sources.store import derive, read_source

CTE = {"website_sessions": ("website_sessions", True), "website_pageviews": ("website_pageviews", True),
       "web_orders": ("web_orders", True), "orders": ("store_orders", False),
       "order_items": ("order_items", False), "order_item_refunds": ("order_item_refunds", False)}


@pytest.mark.parametrize("table", list(CTE))
def test_feed_matches_sql(spark, table):
    tables, _ = derive(spark, SF_SMALL)
    cte, web = CTE[table]
    r = compare(tables[table], duck(SF_SMALL),
                with_feeds(f"SELECT * FROM {cte}", web=web, commerce=not web))
    assert r["cols_equal"] and r["exact"] and r["spark_rows"] == r["duck_rows"], r


def test_bucket_size_does_not_change_sessions(spark):
    events = read_source(spark, SF_SMALL, "events")
    cols = ["event_id", "session_id", "is_start", "is_repeat"]
    base = sorted(feeds.tag_sessions(events, 1).select(*cols).collect())
    for hours in (2, 7, 24, 24 * 40):
        assert sorted(feeds.tag_sessions(events, hours).select(*cols).collect()) == base


def test_hot_user_gap_edges(spark):
    """One user with events across many buckets; a gap of exactly 12 hours
    continues a session, a microsecond more starts a new one."""
    t0 = dt.datetime(2024, 1, 1)
    step = [dt.timedelta(minutes=50)] * 30 + [dt.timedelta(hours=12)] \
        + [dt.timedelta(minutes=7)] * 20 + [dt.timedelta(hours=12, microseconds=1)] \
        + [dt.timedelta(hours=3)] * 10
    rows, t = [], t0
    for i, d in enumerate([dt.timedelta(0)] + step):
        t = t + d
        rows.append((i, t, 42, "click", 1.0, '{"k": 5}'))
    rows.append((1000, t0 + dt.timedelta(hours=1), 7, "view", 2.0, '{"k": 6}'))
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    tagged = feeds.tag_sessions(ev, 1).filter("user_id = 42")
    starts = sorted(r.event_id for r in tagged.filter("is_start").collect())
    assert starts == [0, 52]
    sid = {r.event_id: r.session_id for r in tagged.collect()}
    assert all(sid[i] == 0 for i in range(52)) and all(sid[i] == 52 for i in range(52, 63))
    assert [r.is_repeat for r in tagged.filter("is_start").orderBy("event_id").collect()] == [False, True]


def test_hot_cells_split_into_seconds(spark):
    """With a tiny per-task budget every (user, hour) cell is hot and cut
    into one-second buckets; sessions do not change."""
    events = read_source(spark, SF_SMALL, "events")
    cols = ["event_id", "session_id", "is_start", "is_repeat"]
    base = sorted(feeds.tag_sessions(events, 1).select(*cols).collect())
    spark.conf.set("spark.shoplens.hotKeyRows", "1")
    spark.conf.set("spark.shoplens.hotKeySample", "1.0")
    try:
        split = feeds.tag_sessions(events, 1)
        plan = split._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(split.select(*cols).collect()) == base
        assert "n_split" in plan
    finally:
        spark.conf.unset("spark.shoplens.hotKeyRows")
        spark.conf.unset("spark.shoplens.hotKeySample")


def test_every_purchase_is_an_order(spark):
    tables, _ = derive(spark, SF_SMALL)
    bought = read_source(spark, SF_SMALL, "events").filter("event_type = 'purchase'")
    total = "CAST(SUM(CAST({} AS DECIMAL(12,2))) AS STRING)"
    assert tables["web_orders"].count() == bought.count()
    assert (tables["web_orders"].selectExpr(total.format("price_usd")).first()[0]
            == bought.selectExpr(total.format("value")).first()[0])
    per = tables["web_orders"].groupBy("website_session_id").count()
    assert per.agg({"count": "max"}).first()[0] > 1


def test_null_users_have_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=h), None, "click", 1.0, '{"k": 5}') for i, h in enumerate([0, 5, 30])]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    for hours in (1, 24):
        got = {r.event_id: (r.session_id, r.is_start, r.is_repeat) for r in feeds.tag_sessions(ev, hours).collect()}
        assert got == {0: (0, True, False), 1: (0, False, True), 2: (2, True, True)}


def test_item_ids_of_long_orders_do_not_collide(spark):
    at = dt.datetime(1999, 1, 1)
    rows = [(o, n, 1, i + 1, 10.0, "R", at) for o, lines in ((4, 120), (5, 5)) for i, n in enumerate(range(lines))]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                     "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz")
    items = feeds.number_lines(li)
    assert items.select("order_item_id").distinct().count() == 125
    assert items.filter("is_primary_item = 1").count() == 2


LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
         "l_returnflag string, l_shipdate timestamp_ntz")


def test_an_order_of_any_length(spark):
    """1.2 million lines in one order, a budget of 100,000 rows a task."""
    line = "{0} l_orderkey, id l_partkey, 1L l_suppkey, int(id) l_linenumber, 10D l_extendedprice, " \
           "case when id % 1000 = 0 then 'R' else 'N' end l_returnflag, timestamp_ntz'1999-01-01' l_shipdate"
    long_order = spark.range(1_200_000).selectExpr(*line.format("4L").split(", "))
    li = long_order.unionByName(spark.range(9).selectExpr(*line.format("5L").split(", "))).repartition(8)
    spark.conf.set("spark.shoplens.hotKeyRows", "100000")
    spark.conf.set("spark.shoplens.hotKeySample", "0.01")
    try:
        lines = ranking.kept(feeds.number_lines(li), "test-lines")
    finally:
        spark.conf.unset("spark.shoplens.hotKeyRows")
        spark.conf.unset("spark.shoplens.hotKeySample")
    got = lines.groupBy("order_id").agg(
        F.count("*"), F.count_distinct("order_item_id"), F.sum("is_primary_item"), F.min("order_item_id"), F.max("order_item_id"))
    assert sorted(map(tuple, got.collect())) == [(4, 1_200_000, 1_200_000, 1, -200_001, 4_999_999), (5, 9, 9, 1, 5_000_001, 5_000_009)]
    # ranks follow the order's own order, by the formula and beyond it
    assert lines.where("order_item_id = 4000001 and is_primary_item = 1 and l_linenumber = 0").count() == 1
    assert lines.where("order_id = 4 and order_item_id > 0 and order_item_id <> 4000001 + l_linenumber").count() == 0
    assert lines.where("order_item_id < 0 and order_item_id <> 999998 - l_linenumber").count() == 0
    refunds = feeds.commerce_tables(spark.createDataFrame([], "o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double"), lines).refunds
    assert refunds.agg(F.count("*"), F.count_distinct("order_item_refund_id")).first() == (1201, 1201)


def test_order_keys_of_any_size(spark):
    at = dt.datetime(1999, 1, 1)
    keys = [feeds.LAST_PLAIN_ORDER, feeds.LAST_PLAIN_ORDER + 1, 2**63 - 1, -1, -(2**63), None, 0]
    li = spark.createDataFrame([(k, 1, 1, n, 1.0, "R", at) for k in keys for n in (7, 8)], LINES)
    feed = feeds.commerce_feed(spark.createDataFrame([], "o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double"), li)
    items = {(r.order_id, r.is_primary_item): r.order_item_id for r in feed.order_items.collect()}
    assert items[0, 1] == 1 and items[feeds.LAST_PLAIN_ORDER, 0] == feeds.LAST_PLAIN_ORDER * 10**6 + 2
    assert sorted(i for i in items.values() if i < 0) == list(range(-10, 0)) and len(set(items.values())) == 14
    assert feed.refunds.select("order_item_refund_id").distinct().count() == 21  # line 7 has two


def test_carry_in_two_levels_holds_few_rows(spark):
    """A third of all events belong to one user; with cells cut to seconds no
    window over that user alone holds more than one row per coarse cell."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), 1 if i % 3 == 0 else i, "click", 1.0, '{"k": 5}') for i in range(9000)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    base = sorted(feeds.tag_sessions(ev, 1).select("event_id", "session_id").collect())
    spark.conf.set("spark.shoplens.hotKeyRows", "100")
    spark.conf.set("spark.shoplens.hotKeySample", "1.0")
    try:
        assert sorted(feeds.tag_sessions(ev, 1).select("event_id", "session_id").collect()) == base
    finally:
        spark.conf.unset("spark.shoplens.hotKeyRows")
        spark.conf.unset("spark.shoplens.hotKeySample")
