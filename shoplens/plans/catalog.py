"""Catalog of analyses: operator call, parameters and SQL oracle.

Each entry runs an operator on the store derived from a test-data folder
with the parameters of FIXTURES.md §3.  The oracle states the analysis'
definition in DuckDB SQL over the feed CTEs by another route than the
operator: window functions with QUALIFY, LEAD, EXISTS, bool_or and FILTER
where the operator compares per-session extremes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from shoplens.plans.oracle_feeds import with_feeds
from shoplens.sources.store import Store


@dataclass
class Analysis:
    name: str
    code: str                       # SURVEY §2.A id
    run: Callable[..., DataFrame]   # (store, **params) -> DataFrame
    params: dict = field(default_factory=dict)
    sql: str | Callable[[dict], str] | None = None  # template (``{param}``) or builder
    web: bool = True                # which feed the oracle needs
    commerce: bool = False

    def __call__(self, store: Store) -> DataFrame:
        return self.run(store, **self.params)

    def oracle(self, feeds: bool = True) -> str | None:
        """The SQL oracle; with ``feeds=False`` it reads tables named like
        the logical tables (``web_orders`` / ``store_orders`` for orders)."""
        if self.sql is None:
            return None
        body = self.sql(self.params) if callable(self.sql) else self.sql.format(**self.params)
        return with_feeds(body, web=self.web and feeds, commerce=self.commerce and feeds)


# --- SQL snippets -----------------------------------------------------------

def week(c: str) -> str:
    return f"CAST(strftime({c}, '%U') AS INTEGER)"


def yearweek(c: str) -> str:
    s = f"(CAST({c} AS DATE) - CAST(dayofweek({c}) AS INTEGER))"
    return f"CAST(year({s}) * 100 + (dayofyear({s}) + 6) // 7 AS INTEGER)"


def rt(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF({b}, 0)"


def cdif(cond: str, col: str = "website_session_id") -> str:
    return f"COUNT(DISTINCT CASE WHEN {cond} THEN {col} ELSE NULL END)"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def id_between(p: dict, col: str) -> str:
    """SQL conditions for optional ``id_lo`` / ``id_hi`` parameters."""
    conds = [f"{col} >= {p['id_lo']}" if p.get("id_lo") is not None else "",
             f"{col} <= {p['id_hi']}" if p.get("id_hi") is not None else ""]
    return " AND ".join(c for c in conds if c) or "TRUE"


def yr(c: str) -> str:
    return f"CAST(year({c}) AS INTEGER)"


def mo(c: str) -> str:
    return f"CAST(month({c}) AS INTEGER)"


REGISTRY: dict[str, Analysis] = {}


def register(*analyses: Analysis) -> None:
    for a in analyses:
        REGISTRY[a.name] = a
