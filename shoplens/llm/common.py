"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoplens.session import checkpoint_root

#: The white space that separates words: space and code points 9 to 13.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back:
    lineage ends there, and a lost executor costs only the rereading."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_crc(column: str):
    """crc32 of the id written as text, as the held-out splits use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_bytes(batch: pa.RecordBatch | pa.Table, column: str):
    """The column's texts as bytes, one by one (None for null)."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py()


def byte_slices(batch: pa.RecordBatch, column: str, limit: int):
    """Row slices of the batch whose texts hold about `limit` bytes, or one
    longer text: Arrow batches are bounded by rows, this bounds their bytes."""
    col = batch.column(column)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[start:], dtype=np.int64), limit, side="right")))
        yield batch.slice(start, n)
        start += n


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, ways: int = 16) -> DataFrame:
    """Left join on null-safe keys of which one may hold a large part of left:
    left is dealt over `ways` by a hash of column `by`, right (a row per key) is
    repeated for each."""
    a = left.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).alias("a")
    b = right.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._way") == F.col("b._way")]
    rest = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, on, "left").select(*[F.col(f"a.{c}") for c in left.columns], *rest)
