"""Row numbers over orders and keys of any size.

A window without a partition puts all rows into one task, and a window over a
key puts a hot key's rows into one.  Here rows are dealt out by ranges of the
order itself, so a task holds a bounded share whatever the keys: rows are
numbered inside their range, and a table of one row a range carries the
numbers on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.operators.common import hot_keys, null_safe_join
from shoplens.session import checkpoint_root

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared checkpoint folder and read back: what was
    computed once (range borders, for instance) holds for all later readers."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/shoplens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[str | Column], name: str = "row_number") -> DataFrame:
    """df with a column `name`: 1, 2, ... over all rows in the given order
    (rows equal in it get different numbers, in no particular order).

    Rows are sorted by range, so no task holds more than a range; what crosses
    ranges is one row per range.  The sorted rows are written, since their
    ranges must be the same for the rows and for the counts."""
    spark = df.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows differ in _tie, so a range border can fall between them
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    in_order = (rows.repartitionByRange(ways, *order, "_tie").sortWithinPartitions(*order, "_tie")
                .drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    rows = kept(in_order, "numbered").withColumn("_range", F.shiftright("_at", _ROW_BITS))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_at") - F.shiftleft("_range", _ROW_BITS) + F.col("_before") + 1
    return rows.join(offsets, "_range").withColumn(name, at).drop("_range", "_at", "_before")


def rank_in_key(df: DataFrame, keys: list[str], order: list[str | Column],
                name: str = "rank") -> DataFrame:
    """df with a column `name`: 1, 2, ... within each key (NULL is a key) in
    the given order, as ROW_NUMBER gives it.

    A key within the row budget of a task (`hot_keys`) is ranked by a window.
    Rows of larger keys are numbered all together by range, and a key's first
    number is taken off."""
    hot = kept(hot_keys(df, keys, by=None).select(*keys, F.lit(True).alias("_hot")), "hot-keys")
    window = Window.partitionBy(*keys).orderBy(*order)
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    rows = null_safe_join(df, hot, keys, "left")
    cold = rows.where(F.col("_hot").isNull()).drop("_hot").withColumn(name, F.row_number().over(window).cast("long"))
    numbered = number_rows(rows.where("_hot").drop("_hot"), [*keys, *order], "_number")
    first = numbered.groupBy(*keys).agg(F.min("_number").alias("_first"))
    ranked = null_safe_join(numbered, first, keys, "left").withColumn(name, F.col("_number") - F.col("_first") + 1)
    return cold.unionByName(ranked.drop("_number", "_first"))
