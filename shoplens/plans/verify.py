"""Compare a Spark DataFrame with a DuckDB query result, order-insensitively
(used by tests and ``scripts/check_oracle.py``; DuckDB is imported lazily).

Mirrors the correctness gate: same column names (sorted), same row count,
same multiset of rows.  Floats are compared exactly and, separately, after
rounding to 9 significant digits.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

VIEWS = ("region nation customer supplier part orders lineitem events documents "
         "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    """A DuckDB connection with the driver's parquet tables as views."""
    import duckdb
    con = duckdb.connect()
    for v in VIEWS:
        p = os.path.join(sf_dir, f"{v}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=None):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits:
            return f"{v:.{digits}g}"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_of(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i], digits) for i in order) for r in rows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def _types(spark_df, rel):
    a = {c: SPARK_TO_DUCK.get(t, t.upper()) for c, t in spark_df.dtypes}
    b = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (a[c], b.get(c)) for c in a if a[c] != b.get(c)}


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out = {"cols_equal": sorted(s_cols) == sorted(d_cols), "spark_rows": len(s_rows),
           "duck_rows": len(d_rows)}
    mism = _types(spark_df, rel)
    if mism:
        out["type_mismatch"] = mism
    if not out["cols_equal"]:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
        return out
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    out["exact"] = a == b
    a9, b9 = rows_of(s_cols, s_rows, 9), rows_of(d_cols, d_rows, 9)
    out["approx"] = a9 == b9
    if not out["approx"]:
        sa, sb = set(a9), set(b9)
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_duck"] = sorted(sb - sa)[:3]
    out["hash"] = hashlib.sha1(repr(a).encode()).hexdigest()[:10]
    return out
