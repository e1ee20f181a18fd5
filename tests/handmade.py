"""Randomised hand-made stores (a few dozen rows per table).

They exercise what the test feeds never produce: several orders per
session, several new sessions per user, sessions without pageviews, NULL
and unknown channels, two refunds per item, repeated cart and product
views, orders without items, and timestamps exactly on the parameter
bounds.
"""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

from shoplens.sources import schemas
from shoplens.sources.store import Store

URLS = ["/home", "/lander-1", "/lander-2", "/products", "/the-original-mr-fuzzy",
        "/the-forever-love-bear", "/cart", "/shipping", "/billing", "/billing-2",
        "/thank-you-for-your-order"]
CHANNELS = [("gsearch", "nonbrand", "https://www.gsearch.com"),
            ("gsearch", "brand", "https://www.gsearch.com"),
            ("bsearch", "nonbrand", "https://www.bsearch.com"),
            ("bsearch", "brand", "https://www.bsearch.com"),
            ("socialbook", "pilot", "https://www.socialbook.com"),
            (None, None, "https://www.gsearch.com"),
            (None, None, "https://www.bsearch.com"),
            (None, None, None),
            (None, None, "https://elsewhere.example")]
WEB_BOUNDS = ["2024-01-01", "2024-01-03", "2024-01-05", "2024-01-15", "2024-01-20",
              "2024-01-25", "2024-01-28"]
SHOP_BOUNDS = ["1998-01-04", "1998-09-30", "1999-10-15", "2000-10-15"]


def _ts(rng, lo, hi, bounds):
    if rng.random() < 0.12:
        return dt.datetime.fromisoformat(rng.choice(bounds))
    span = (hi - lo).total_seconds()
    return lo + dt.timedelta(seconds=int(rng.random() * span), microseconds=rng.randrange(10**6))


def _money(rng):
    return Decimal(rng.randrange(100, 20000)) / 100


def random_tables(seed: int, n_sessions: int = 60, empty: bool = False) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    if empty:
        return {t: [] for t in schemas.TABLES}
    # half in the month the parameters point at, half over two year ends
    spans = [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30)), (dt.datetime(2022, 12, 18), dt.datetime(2024, 2, 10))]
    sessions, pageviews, web_orders = [], [], []
    sids = rng.sample(range(1, 10 * n_sessions), n_sessions)
    pv_id, o_id = 1, 10_000
    for sid in sids:
        at = _ts(rng, *rng.choice(spans), WEB_BOUNDS)
        src, camp, ref = rng.choice(CHANNELS)
        sessions.append((sid, at, rng.randrange(1, 15), int(rng.random() < 0.55), src, camp, ref,
                         rng.choice(["mobile", "desktop"])))
        t = at
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            pageviews.append((pv_id, t, sid, rng.choice(URLS)))
            pv_id += rng.randrange(1, 4)
            t = t + dt.timedelta(minutes=rng.randrange(1, 600))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            price = _money(rng)
            web_orders.append((o_id, t, sid, rng.randrange(1, 5), rng.randrange(1, 4), price,
                               (price * Decimal("0.4000"))))
            o_id += 1
    slo, shi = dt.datetime(1997, 6, 1), dt.datetime(2001, 1, 1)
    orders, items, refunds = [], [], []
    oids = sorted(set(rng.sample(range(1, 1400), 90)) | {3, 77, 1200})
    iid, rid = 1, 1
    for oid in oids:
        lines = rng.choice([0, 1, 1, 2, 3, 4])
        prods = [rng.randrange(1, 5) for _ in range(lines)]
        price = _money(rng)
        orders.append((oid, _ts(rng, slo, shi, SHOP_BOUNDS), None, prods[0] if prods else None,
                       lines, price, price * Decimal("0.6000")))
        for j, p in enumerate(prods):
            it = _ts(rng, slo, shi, SHOP_BOUNDS)
            items.append((iid, oid, p, int(j == 0), _money(rng), it))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                refunds.append((rid, iid, _money(rng), it + dt.timedelta(days=rng.randrange(1, 30))))
                rid += 1
            iid += 1
    return {"website_sessions": sessions, "website_pageviews": pageviews, "web_orders": web_orders,
            "orders": orders, "order_items": items, "order_item_refunds": refunds}


DUCK_NAMES = {"orders": "store_orders"}


def build(spark, tables: dict[str, list[tuple]], folder: str):
    """(Store of Spark DataFrames, DuckDB connection over the same rows)."""
    import duckdb
    con = duckdb.connect()
    frames = {}
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, schemas.TABLES[name])
        path = os.path.join(folder, name)
        df.coalesce(1).write.mode("overwrite").parquet(path)
        frames[name] = spark.read.schema(schemas.TABLES[name]).parquet(path)
        con.execute(f"CREATE VIEW {DUCK_NAMES.get(name, name)} AS "
                    f"SELECT * FROM read_parquet('{path}/*.parquet')")
    return Store(**frames), con
