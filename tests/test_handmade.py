"""Differential tests on randomised hand-made stores: each analysis equals
its literal SQL formulation, including on empty tables."""

import tempfile

import pytest

from handmade import build, random_tables
from shoplens.plans import REGISTRY
from shoplens.plans.verify import compare

NAMES = sorted(REGISTRY)
CASES = {"seed1": dict(seed=1), "seed2": dict(seed=2, n_sessions=90), "seed5": dict(seed=5, n_sessions=200),
         "empty": dict(seed=0, empty=True)}


@pytest.fixture(scope="module", params=list(CASES))
def case(request, spark):
    folder = tempfile.mkdtemp(prefix="shoplens-handmade-")
    return build(spark, random_tables(**CASES[request.param]), folder)


@pytest.mark.parametrize("name", NAMES)
def test_handmade_matches_literal_sql(case, name):
    store, con = case
    a = REGISTRY[name]
    r = compare(a(store), con, a.oracle(feeds=False))
    assert r["cols_equal"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["exact"], r


#: Analyses with an order, their sort column and direction.
ORDERED = {"top_traffic_sources": ("number_of_sessions", True), "top_pages": ("sessions", True),
           "referrer_traffic_type": ("sessions", True), "repeat_session_histogram_sum": ("repeat_sessions", False),
           "channel_new_vs_repeat": ("repeat_sessions", True), "primary_product_pnl": ("orders", True),
           "monthly_conversion_revenue": ("conversion_rates", True), "cross_sell_pairs": ("orders", True)}


@pytest.mark.parametrize("name", list(ORDERED))
def test_rows_come_in_order(case, name):
    store, _ = case
    column, down = ORDERED[name]
    rows = [r[column] for r in REGISTRY[name](store).collect()]
    known = [x for x in rows if x is not None]
    assert known == sorted(known, reverse=down)


def test_the_data_cross_year_ends(spark):
    store, _ = build(spark, random_tables(seed=5, n_sessions=200), tempfile.mkdtemp(prefix="shoplens-years-"))
    assert REGISTRY["monthly_volume"](store).count() > 10
    assert REGISTRY["monthly_channel_group_mix"](store).count() > 10
    assert {r.year for r in REGISTRY["weekly_volume"](store).collect()} == {2022, 2023, 2024}
    from shoplens.operators.products import monthly_conversion_revenue
    assert monthly_conversion_revenue(store.sessions, store.web_orders, "2022-12-01", "2024-02-28").count() > 10


#: Parameters that no registered analysis sets, each against the oracle with the same parameters.
VARIANTS = {"landing_page_test": [dict(launch_id=20), dict(launch_id=20, launch_inclusive=True)],
            "page_version_order_test": [dict(min_pv_id=15), dict(since_url="/home")],
            "refund_lookup": [dict(order_ids=()), dict(order_ids=(77,))],
            "cross_sell_pairs": [dict(id_lo=200), dict(id_hi=900)],
            "cross_sell_matrix": [dict(id_lo=200, id_hi=900, products=(2, 4))],
            "weekly_landing_trend_raw": [dict(pages={"a": "/home", "b": "/cart", "c": "/billing"})]}


@pytest.mark.parametrize("name, params", [(n, p) for n, ps in VARIANTS.items() for p in ps])
def test_parameter_variants(case, name, params):
    from dataclasses import replace
    store, con = case
    a = replace(REGISTRY[name], params={**REGISTRY[name].params, **params})
    r = compare(a(store), con, a.oracle(feeds=False))
    assert r["cols_equal"] and r["spark_rows"] == r["duck_rows"] and r["exact"], r
