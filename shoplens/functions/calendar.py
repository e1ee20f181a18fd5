"""Calendar functions with the reporting conventions the analyses use.

``week_number`` is the Sunday-first week of the year, 0-53, where days before
the year's first Sunday are week 0 (not ISO ``weekofyear``).
``year_week`` is year*100 + week, where week-0 days belong to the previous
year's last week.  Both are pure Column expressions (codegen, no UDF).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_number(ts) -> Column:
    """Sunday-first week of the year, 0..53."""
    d = F.to_date(_col(ts))
    # dayofweek: Sunday = 1 .. Saturday = 7
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def year_week(ts) -> Column:
    """year * 100 + Sunday-first week, week-0 days folded into last year."""
    d = F.to_date(_col(ts))
    sunday = F.date_sub(d, F.dayofweek(d) - 1)
    return (F.year(sunday) * 100 + F.floor((F.dayofyear(sunday) + 6) / 7)).cast("int")


def day(ts) -> Column:
    return F.to_date(_col(ts))


def weekday(ts) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(_col(ts))


# Names under which SURVEY §2.F lists these functions (MySQL WEEK / YEARWEEK, mode 0).
mysql_week = week_number
mysql_yearweek = year_week
