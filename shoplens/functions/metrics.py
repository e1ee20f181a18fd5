"""Small Column helpers shared by the operators.

Numeric conventions (same on the SQL oracle side): counts are BIGINT,
ratios are DOUBLE and NULL when the divisor is 0, money is summed exactly as
DECIMAL and returned as DOUBLE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _name(c) -> str | None:
    """``c`` as a quoted SQL identifier if it is a plain column name."""
    return f"`{c}`" if isinstance(c, str) and c.isidentifier() else None


def ratio(num, den) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL."""
    a, b = _name(num), _name(den)
    if a and b:  # one expression instead of five column calls
        return F.expr(f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def count_if(cond: Column) -> Column:
    """Rows where ``cond`` is true (BIGINT, 0 when none)."""
    return F.count_if(cond)


def money(c) -> Column:
    return _col(c).cast("double")


def sum_money(c) -> Column:
    """Exact decimal sum, returned as DOUBLE."""
    return F.sum(_col(c)).cast("double")


def half_up_avg_1(total, n) -> Column:
    """ROUND(total / n, 1) with half-up rounding, computed on integers so it
    does not depend on floating point; NULL when n is 0."""
    total, n = _col(total).cast("long"), _col(n).cast("long")
    num, den = total * 20 + n, n * 2
    whole = (num - num % den) / den          # exact: num - num % den is a multiple of den
    return F.when(n > 0, whole / 10.0)


def ts_text(value) -> str:
    """A time parameter (datetime, date or ISO text) in ISO form; ValueError for anything else."""
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    dt.datetime.fromisoformat(str(value))
    return str(value)


def ts_lit(value) -> Column:
    """A time parameter as a TIMESTAMP_NTZ literal (no session time zone)."""
    return F.lit(ts_text(value)).cast("timestamp_ntz")


def in_range(c, after=None, before=None, start=None, end=None) -> Column:
    """Time predicate: ``after``/``before`` are exclusive bounds,
    ``start``/``end`` inclusive ones (``BETWEEN``).  Unset bounds are open."""
    name = _name(c)
    if name:  # one expression with typed literals
        parts = [f"{name} {op} TIMESTAMP_NTZ '{ts_text(v)}'" for op, v in
                 ((">", after), ("<", before), (">=", start), ("<=", end)) if v is not None]
        return F.expr(" AND ".join(parts) or "TRUE")
    c = _col(c)
    cond = F.lit(True)
    if after is not None:
        cond = cond & (c > ts_lit(after))
    if before is not None:
        cond = cond & (c < ts_lit(before))
    if start is not None:
        cond = cond & (c >= ts_lit(start))
    if end is not None:
        cond = cond & (c <= ts_lit(end))
    return cond


def id_range(lo=None, hi=None, col: str = "order_id") -> Column:
    """``col BETWEEN lo AND hi``; an unset bound is open."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(col) >= lo)
    if hi is not None:
        cond = cond & (F.col(col) <= hi)
    return cond
