"""Row numbers against plain windows, with hot keys and equal rows."""

import random

import pytest
from pyspark.sql import functions as F

from shoplens.operators import common, ranking
from shoplens.operators.ranking import number_rows, rank_in_key


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(50), i) for i in range(3000)]
    data += [(1, 7, 0)] * 500  # equal rows
    return spark.createDataFrame(data, "k long, v long, id long").repartition(6)


def test_number_rows(spark, rows):
    got = number_rows(rows, ["v", "id"]).orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(1, 3501))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in rows.collect())
    assert number_rows(rows.limit(0), ["v"]).collect() == []


@pytest.mark.parametrize("budget", ["4000000", "100"])
def test_rank_in_key(spark, rows, budget):
    spark.conf.set(common.HOT_ROWS_CONF, budget)
    spark.conf.set(common.HOT_SAMPLE_CONF, "1.0")
    try:
        got = [tuple(r) for r in rank_in_key(rows, ["k"], ["v", "id"]).collect()]
    finally:
        spark.conf.unset(common.HOT_ROWS_CONF)
        spark.conf.unset(common.HOT_SAMPLE_CONF)
    want = []
    for k in (None, 1, 2, 3):
        mine = sorted((r.v, r.id) for r in rows.collect() if r.k == k)
        want += [(k, v, i, n) for n, (v, i) in enumerate(mine, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_task_holds_a_range_not_a_key(spark, rows, monkeypatch):
    """All rows equal: the written ranges share them out."""
    written = []
    monkeypatch.setattr(ranking, "kept", lambda df, name, keep=ranking.kept: written.append(keep(df, name)) or written[-1])
    one = rows.withColumn("k", F.lit(1)).withColumn("v", F.lit(0)).withColumn("id", F.lit(0))
    assert ranking.number_rows(one, ["k", "v"]).agg(F.count_distinct("row_number")).first()[0] == 3500
    share = [r["n"] for r in written[0].groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect()]
    assert sum(share) == 3500 and max(share) < 3500 / 4
