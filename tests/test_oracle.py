"""Every analysis equals its literal SQL formulation (DuckDB) on the feeds
derived from the driver's sf0.001 tables."""

import pytest

from samples import SF_SMALL
from shoplens.plans import REGISTRY
from shoplens.plans.verify import compare, duck
from shoplens.sources.store import load_store

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def store(spark):
    return load_store(spark, SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, store, con, name):
    a = REGISTRY[name]
    r = compare(a(store), con, a.oracle())
    assert r["cols_equal"], r
    assert "type_mismatch" not in r, r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["exact"], r


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["device_type", "sessions", "orders", "conversion_rt"]
    assert df.count() >= 0
    assert set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())


def test_register_views(spark, store):
    names = store.register_views(prefix="t_")
    assert "t_website_sessions" in names
    n = spark.sql("SELECT COUNT(*) AS n FROM t_website_sessions").first().n
    assert n == store.sessions.count()
