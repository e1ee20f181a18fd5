"""Week numbering: Sunday-first week of year (0-53) and year-week."""

import datetime as dt

from pyspark.sql import functions as F

from shoplens.functions.calendar import week_number, year_week


def _py_yearweek(d: dt.date) -> int:
    sunday = d - dt.timedelta(days=(d.weekday() + 1) % 7)
    return sunday.year * 100 + int(sunday.strftime("%U"))


def test_week_functions_match_python(spark):
    start, days = dt.date(1990, 1, 1), 16801  # through 2035-12-31
    df = (spark.range(days)
          .select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
          .select("d", week_number("d").alias("w"), year_week("d").alias("yw")))
    rows = df.collect()
    assert len(rows) == days
    for r in rows:
        assert r.w == int(r.d.strftime("%U")), r
        assert r.yw == _py_yearweek(r.d), r


def test_week_is_not_iso(spark):
    r = spark.range(1).select(week_number(F.lit("2012-01-01").cast("date")).alias("w"),
                              F.weekofyear(F.lit("2012-01-01").cast("date")).alias("iso")).first()
    assert (r.w, r.iso) == (1, 52)
