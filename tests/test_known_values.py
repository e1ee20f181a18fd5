"""
regression anchors (independent of the SQL oracles)."""

import pytest
from pyspark.sql import functions as F

from shoplens.functions.calendar import week_number, year_week
from shoplens.plans import REGISTRY
from shoplens.sources.store import load_store

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def store(spark):
    return load_store(spark, SF)


def test_feed_row_counts(store):
    counts = {t: getattr(store, t).count() for t in
              ("website_sessions", "website_pageviews", "web_orders", "orders", "order_items",
               "order_item_refunds")}
    assert counts == {"website_sessions": 3292, "website_pageviews": 10000, "web_orders": 1981,
                      "orders": 15000, "order_items": 60000, "order_item_refunds": 22887}


def test_week_zero_sessions(store):
    s = store.sessions.filter(F.to_date("created_at") <= F.lit("2024-01-06").cast("date"))
    assert s.count() == 699
    assert {tuple(r) for r in s.select(week_number("created_at"), year_week("created_at"))
            .distinct().collect()} == {(0, 202353)}


def test_single_page_and_cart_counts(store):
    per = store.pageviews.groupBy("website_session_id").agg(F.count("*").alias("n"))
    assert per.filter("n = 1").count() == 1136
    carts = store.pageviews.filter(F.col("pageview_url") == "/cart")
    assert carts.count() == 1326
    assert carts.select("website_session_id").distinct().count() == 958


def test_cart_fan_out_is_visible(store):
    raw = {r.time_period: r for r in REGISTRY["cart_pre_post_raw"](store).collect()}
    post = raw["A. Post_Cross_Sell"]
    assert (post.cart_sessions, post.clickthrough) == (416, 1614)
    dedup = {r.time_period: r for r in REGISTRY["cart_pre_post"](store).collect()}
    assert dedup["B. Post_Cross_Sell"].cart_sessions == 416
    assert dedup["B. Post_Cross_Sell"].clickthrough <= 416


def test_one_new_session_per_user_so_u1_equals_u2(store):
    a = sorted(map(tuple, REGISTRY["repeat_session_histogram_sum"](store).collect()))
    b = sorted(map(tuple, REGISTRY["repeat_session_histogram"](store).collect()))
    assert a == b


def test_funnel_pairs_sum_to_the_surveyed_rows(store):
    """Every view of a product page with every later pageview: 2,062 pairs, in fewer rows."""
    pairs = REGISTRY["funnel_page_pairs"](store)
    assert pairs.agg({"n_pairs": "sum"}).first()[0] == 2062
    assert pairs.groupBy("website_session_id", "product_page_seen", "website_pageview_id").count().where("count > 1").isEmpty()
