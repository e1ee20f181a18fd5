"""The plan shapes of a large cluster, forced at small scale: no broadcast
joins (every join shuffles) and AQE skew-join splitting on tiny partitions.
Results must not change."""

import tempfile

import pytest

from handmade import build, random_tables
from shoplens.plans import REGISTRY
from shoplens.plans.verify import compare

SCALE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def scaled(spark):
    old = {k: spark.conf.get(k, None) for k in SCALE_CONF}
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)
    folder = tempfile.mkdtemp(prefix="shoplens-scale-")
    yield build(spark, random_tables(seed=7, n_sessions=120), folder)
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_shuffle_and_skew_plans_keep_results(scaled, name):
    store, con = scaled
    a = REGISTRY[name]
    df = a(store)
    r = compare(df, con, a.oracle(feeds=False))
    assert r["cols_equal"] and r["spark_rows"] == r["duck_rows"] and r["exact"], r
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()  # final adaptive plan
    bad = ["BroadcastExchange", "CartesianProduct", "BroadcastNestedLoopJoin", "Expand"]
    bad.append("SortAggregate")
    for b in bad:
        assert b not in plan, (name, b)


HOT_CONF = {**SCALE_CONF, "spark.shoplens.hotKeyRows": "20", "spark.shoplens.hotKeySample": "1.0"}


def _with_hot_keys(tables):
    """One session gets a third of all pageviews, one user a third of all
    sessions (and the items of one order a third of all items)."""
    import datetime as dt
    from handmade import URLS
    sid, at = tables["website_sessions"][0][0], tables["website_sessions"][0][1]
    n = len(tables["website_pageviews"])
    tables["website_pageviews"] += [(10**7 + i, at + dt.timedelta(minutes=i), sid, URLS[(i * 7) % len(URLS)])
                                    for i in range(n // 2)]
    hot_user = tables["website_sessions"][1][2]
    tables["website_sessions"] = [r[:2] + (hot_user,) + r[3:] if i % 2 == 0 else r
                                  for i, r in enumerate(tables["website_sessions"])]
    oid, it = tables["order_items"][0][1], tables["order_items"][0][5]
    m = len(tables["order_items"])
    tables["order_items"] += [(10**7 + i, oid, 1 + i % 4, 0, tables["order_items"][0][4], it)
                              for i in range(m // 2)]
    return tables


@pytest.fixture(scope="module")
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in HOT_CONF}
    for k, v in HOT_CONF.items():
        spark.conf.set(k, v)
    folder = tempfile.mkdtemp(prefix="shoplens-hot-")
    yield build(spark, _with_hot_keys(random_tables(seed=11, n_sessions=120)), folder)
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_hot_keys_are_split_without_changing_results(hot, name):
    store, con = hot
    a = REGISTRY[name]
    df = a(store)
    r = compare(df, con, a.oracle(feeds=False))
    assert r["cols_equal"] and r["spark_rows"] == r["duck_rows"] and r["exact"], r
    if name in ("next_page_pathing", "funnel_page_flags", "repeat_session_histogram"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and "sequence" in plan, name
