"""Product-level analyses: P&L, monthly sales, pathing, product funnels,
cross-sell, cart pre/post, portfolio expansion, refunds.

"Pageviews later in the same session" comparisons (an inequality self-join
in SQL) are computed from per-session extremes: a step page is reached after
a product page iff the step's largest pageview id in the session exceeds the
product page's smallest one.  One aggregate over pageviews, combined
map-side, with no pairs of pageviews.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.metrics import count_if, id_range, in_range, ratio, sum_money, ts_lit
from shoplens.operators.common import (SID, cohort, from_first, n_orders, n_sessions,
                                       orders_per_session, split_hot_join, with_orders)

PV = "website_pageview_id"
URL = "pageview_url"


def _period(ts_col: str, split, labels: Sequence[str]):
    return F.when(F.col(ts_col) < ts_lit(split), labels[0]).otherwise(labels[1])


# --- sales -------------------------------------------------------------------

def primary_product_pnl(orders: DataFrame) -> DataFrame:
    """Per primary product: orders, revenue, margin, average order value."""
    return (orders.groupBy("primary_product_id")
            .agg(F.count("order_id").alias("orders"),
                 sum_money("price_usd").alias("revenues"),
                 sum_money(F.col("price_usd") - F.col("cogs_usd")).alias("margin"),
                 ratio(F.sum("price_usd"), F.count("price_usd")).alias("average_order_value"))
            .orderBy(F.desc("orders")))


def monthly_sales(orders: DataFrame, upto) -> DataFrame:
    """Per (year, month) up to and including ``upto``: orders, revenue,
    margin."""
    return (orders.filter(in_range("created_at", end=upto))
            .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
            .agg(F.count("order_id").alias("total_orders"),
                 sum_money("price_usd").alias("total_revenues"),
                 sum_money(F.col("price_usd") - F.col("cogs_usd")).alias("total_margin")))


def monthly_conversion_revenue(sessions: DataFrame, orders: DataFrame, start, end) -> DataFrame:
    """Per (year, month), sessions in [start, end]: sessions, orders,
    conversion rate, revenue per session; best converting month first."""
    s = cohort(sessions, start=start, end=end).select(SID, "created_at")
    return (with_orders(s, orders)
            .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
            .agg(n_sessions().alias("sessions"), n_orders().alias("orders"),
                 sum_money("revenue").alias("revenue"))
            .select("year", "month", "sessions", "orders",
                    ratio("orders", "sessions").alias("conversion_rates"),
                    ratio("revenue", "sessions").alias("revenue_per_session"))
            .orderBy(F.desc("conversion_rates")))


# --- pathing and product funnels ----------------------------------------------

def next_page_pathing(pageviews: DataFrame, from_url: str, targets: Mapping[str, str],
                      split, after, before,
                      labels: Sequence[str] = ("A. Pre_New_Product_Launch",
                                               "B. Post_New_Product_Launch"),
                      heavy: DataFrame | None = None) -> DataFrame:
    """Per period (before / from ``split``): sessions that viewed
    ``from_url`` in (after, before), how many went on to another page, and
    how many went next to each target page, with shares.

    A session is counted once per period in which it viewed ``from_url``;
    its next page is the first pageview after its first such view.
    ``heavy``: the store's sessions of many pageviews.
    """
    seen = (F.col(URL) == from_url) & in_range("created_at", after=after, before=before)
    src = (pageviews.filter(seen)
           .groupBy(_period("created_at", split, labels).alias("time_period"), SID)
           .agg(F.min(PV).alias("from_id")))
    # the next page is X iff the smallest later id is the smallest later id of X
    pid, url = F.col("pid"), F.col(URL)
    nxt = (split_hot_join(from_first(pageviews, seen).select(SID, F.col(PV).alias("pid"), URL),
                          src, [SID], salt_by="pid", heavy=heavy)
           .filter(pid > F.col("from_id"))
           .groupBy("time_period", SID)
           .agg(F.min("pid").alias("next"), F.min(F.when(url.isNotNull(), pid)).alias("known"),
                *[F.min(F.when(url == u, pid)).alias(f"next_{lab}") for lab, u in targets.items()]))
    # sessions per period come from the source side; next-page counts from
    # the sessions that have a next page; both are a row per period
    sessions = src.groupBy("time_period").agg(n_sessions().alias("sessions"))
    moved = (nxt.groupBy("time_period")
             .agg(count_if(F.col("next") == F.col("known")).alias("next_page_session"),
                  *[count_if(F.col("next") == F.col(f"next_{lab}")).alias(f"to_{lab}") for lab in targets]))
    counts = ["next_page_session"] + [f"to_{lab}" for lab in targets]
    cols = ["time_period", "sessions", "next_page_session",
            ratio("next_page_session", "sessions").alias("next_page_session_percentage")]
    for lab in targets:
        cols += [f"to_{lab}", ratio(f"to_{lab}", "sessions").alias(f"to_{lab}_percentage")]
    return (sessions.join(moved, "time_period", "left")
            .select("time_period", "sessions", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
            .select(*cols))


def _product_extremes(pageviews: DataFrame, products: Sequence[str], after, before,
                      steps: Sequence[str] = ()) -> DataFrame:
    """Per session: first in-window view id of each product page
    (``a0``, ``a1``, ...), last view id of each step page (``b0``, ...) and
    the session's last pageview id."""
    url, pid = F.col(URL), F.col(PV)
    win = in_range("created_at", after=after, before=before)
    aggs = [F.min(F.when((url == p) & win, pid)).alias(f"a{i}") for i, p in enumerate(products)]
    aggs += [F.max(F.when(url == s, pid)).alias(f"b{j}") for j, s in enumerate(steps)]
    aggs.append(F.max(pid).alias("last_pv"))
    return (from_first(pageviews, url.isin(*products) & win)
            .filter(F.col(SID).isNotNull()).groupBy(SID).agg(*aggs))


def pages_after(pageviews: DataFrame, product_urls: Sequence[str], after, before) -> DataFrame:
    """Distinct URLs seen after any view of a product page in (after,
    before) in the same session; NULL when some such view was the session's
    last pageview."""
    url, pid = F.col(URL), F.col(PV)
    prod = url.isin(*product_urls) & in_range("created_at", after=after, before=before)
    views = from_first(pageviews, prod).filter(F.col(SID).isNotNull())
    span = (views.groupBy(SID)
            .agg(F.min(F.when(prod, pid)).alias("first_product"),
                 F.max(F.when(prod, pid)).alias("last_product"),
                 F.max(pid).alias("last_pv"))
            .filter(F.col("first_product").isNotNull()))
    # everything after the first product view covers everything after any; of
    # each page only a session's last view matters
    last = views.groupBy(SID, URL).agg(F.max(PV).alias("last_seen"))
    later = (last.join(span.select(SID, "first_product"), SID)
             .filter(F.col("last_seen") > F.col("first_product"))
             .select(URL))
    dangling = (span.filter(F.col("last_product") == F.col("last_pv"))
                .select(F.lit(None).cast("string").alias(URL)))
    return later.unionByName(dangling).distinct()


#: Pageviews of a session whose ids agree but for these low bits are a bucket.
ID_BUCKET_BITS = 20


def funnel_page_flags(pageviews: DataFrame, product_urls: Sequence[str],
                      steps: Mapping[str, str], after, before, ordered: bool = True,
                      heavy: DataFrame | None = None) -> DataFrame:
    """Pageview-grain detail behind ``product_funnel``: for each session and
    product page first viewed in (after, before), one row per later pageview
    of the session with a 0/1 flag per step page (one all-zero row when
    nothing follows).  This redefines the surveyed detail, which pairs every
    product view with every later pageview (2,062 rows at sf0.01, quadratic in
    a session's views): rows follow the product page's *first* view (1,729
    rows), so a product page viewed twice does not repeat them."""
    url = F.col(URL)
    seen = (url.isin(*product_urls) & in_range("created_at", after=after, before=before)
            & F.col(SID).isNotNull())
    views = from_first(pageviews, seen)
    firsts = (pageviews.filter(seen)
              .groupBy(SID, url.alias("product_page_seen"))
              .agg(F.min(PV).alias("from_id")))
    last = views.groupBy(SID).agg(F.max(PV).alias("last_pv"))
    flags = [(url == u).cast("int").alias(f"{lab}_page") for lab, u in steps.items()]
    later = (split_hot_join(views.select(SID, PV, URL, F.col("created_at").alias("seen_at")),
                            firsts, [SID], salt_by=PV, heavy=heavy)
             .filter(F.col(PV) > F.col("from_id"))
             .select(SID, "product_page_seen", *flags, "seen_at"))
    zero = [F.lit(0).alias(f"{lab}_page") for lab in steps]
    nothing_after = (firsts.join(last, SID, "inner")
                     .filter(F.col("from_id") == F.col("last_pv"))
                     .select(SID, "product_page_seen", *zero,
                             F.lit(None).cast("timestamp_ntz").alias("seen_at")))
    out = later.unionByName(nothing_after)
    if ordered:
        out = out.orderBy(SID, "seen_at")
    return out.drop("seen_at")


def funnel_page_pairs(pageviews: DataFrame, product_urls: Sequence[str],
                      steps: Mapping[str, str], after, before) -> DataFrame:
    """The surveyed detail behind ``product_funnel`` with its multiplicities:
    every view of a product page in (after, before) is paired with every later
    pageview of its session (with nothing, if there is none).  The pairs of one
    product page and one later pageview differ in nothing, so they are one row
    with their number, ``n_pairs``: rows grow with the pageviews, while the
    pairs grow with their square.

    ``n_pairs`` is the number of the page's views before the later pageview: a
    running count, taken inside buckets of a million ids and over a session's
    buckets, so that no task holds a session's pageviews."""
    url, pid = F.col(URL), F.col(PV)
    seen = url.isin(*product_urls) & in_range("created_at", after=after, before=before)
    n = range(len(product_urls))
    views = (from_first(pageviews, seen & F.col(SID).isNotNull()).filter(F.col(SID).isNotNull())
             .select(SID, PV, URL, F.shiftright(pid, ID_BUCKET_BITS).alias("bucket"),
                     *[F.coalesce(seen & (url == p), F.lit(False)).cast("long").alias(f"s{i}")
                       for i, p in enumerate(product_urls)]))
    cell = [SID, "bucket"]
    earlier = Window.partitionBy(*cell).orderBy(PV).rowsBetween(Window.unboundedPreceding, -1)
    counted = views.select(SID, PV, URL, "bucket", *[f"s{i}" for i in n],
                           *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"n{i}") for i in n])
    buckets = Window.partitionBy(SID).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (views.groupBy(*cell).agg(F.max(PV).alias("last"), *[F.sum(f"s{i}").alias(f"t{i}") for i in n])
               .select(*cell, F.max("last").over(Window.partitionBy(SID)).alias("last_pv"),
                       *[F.coalesce(F.sum(f"t{i}").over(buckets), F.lit(0)).alias(f"c{i}") for i in n]))
    # beside the pairs with this pageview, the last one's own view has nothing after it
    def of(i, count, paired):
        return F.struct(F.lit(product_urls[i]).alias("product_page_seen"), count.alias("n_pairs"), F.lit(paired).alias("paired"))
    rows = F.array(*[of(i, F.col(f"n{i}") + F.col(f"c{i}"), True) for i in n],
                   *[of(i, F.when(pid == F.col("last_pv"), F.col(f"s{i}")).otherwise(0), False) for i in n])
    pairs = (counted.join(carried, cell)
             .select(SID, PV, URL, F.explode(F.filter(rows, lambda r: r["n_pairs"] > 0)).alias("r"))
             .select(SID, "r.*", F.when(F.col("r.paired"), pid).alias(PV), F.when(F.col("r.paired"), url).alias(URL)))
    # views without a session: nothing follows them
    lost = (pageviews.filter(seen & F.col(SID).isNull()).groupBy(SID, url.alias("product_page_seen"))
            .agg(F.count(F.lit(1)).alias("n_pairs"))
            .select(SID, "product_page_seen", "n_pairs", F.lit(False).alias("paired"),
                    F.lit(None).cast("long").alias(PV), F.lit(None).cast("string").alias(URL)))
    flags = [F.coalesce(url == u, F.lit(False)).cast("int").alias(f"{lab}_page") for lab, u in steps.items()]
    return pairs.unionByName(lost).select(SID, "product_page_seen", PV, *flags, "n_pairs")


def product_funnel(pageviews: DataFrame, products: Mapping[str, str], steps: Mapping[str, str],
                   after, before, entry_label: str = "product_page") -> DataFrame:
    """Per product page viewed in (after, before): sessions, sessions that
    reached each step page later in the session, and step click rates."""
    plabels, purls = list(products), list(products.values())
    slabels, surls = list(steps), list(steps.values())
    ext = _product_extremes(pageviews, purls, after, before, surls)
    rows = F.explode(F.array(*[
        F.struct(F.lit(lab).alias("product_seen"), F.col(f"a{i}").alias("a"),
                 *[F.col(f"b{j}").alias(f"b{j}") for j in range(len(surls))])
        for i, lab in enumerate(plabels)])).alias("r")
    per = ext.select(SID, rows).select(SID, "r.*").filter(F.col("a").isNotNull())
    agg = per.groupBy("product_seen").agg(
        n_sessions().alias("sessions"),
        *[count_if(F.col(f"b{j}") > F.col("a")).alias(f"to_{lab}") for j, lab in enumerate(slabels)])
    prev_count, prev_label = "sessions", entry_label
    for lab in slabels:
        agg = agg.withColumn(f"{prev_label}_click_rt", ratio(f"to_{lab}", prev_count))
        prev_count, prev_label = f"to_{lab}", lab
    return agg


# --- cross-sell ----------------------------------------------------------------

def single_item_primary_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Item-grain detail of the primary line of one-item orders."""
    o = orders.filter(F.col("items_purchased") == 1).select("order_id", "primary_product_id",
                                                            "items_purchased")
    i = items.filter(F.col("is_primary_item") == 1).select("order_item_id", "order_id", "product_id",
                                                          "is_primary_item")
    return (o.join(i, "order_id", "inner")
            .select("order_item_id", "order_id", "product_id", "primary_product_id",
                    "is_primary_item", "items_purchased"))


def cross_sell_pairs(orders: DataFrame, items: DataFrame, id_lo: int | None = None,
                     id_hi: int | None = None) -> DataFrame:
    """(primary product, other product in the order) pairs: order lines,
    most first."""
    rng = id_range(id_lo, id_hi)
    o = orders.filter(rng).select("order_id", "primary_product_id")
    # lines per (order, product) first: a hot order becomes a few rows
    i = items.filter(rng).groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return (o.join(i, "order_id", "inner")
            .filter(F.col("primary_product_id") != F.col("product_id"))
            .groupBy("primary_product_id", "product_id")
            .agg(F.sum("n").alias("orders"))
            .orderBy(F.desc("orders")))


def cross_sell_matrix(orders: DataFrame, items: DataFrame, id_lo: int | None = None,
                      id_hi: int | None = None, products: Sequence[int] = (1, 2, 3),
                      distinct_orders: bool = False) -> DataFrame:
    """Per primary product: order rows joined with their non-primary items
    (an order with two such items counts twice, as the join gives; once with
    ``distinct_orders``), items cross-sold per product, and their rate over
    those rows."""
    rng = id_range(id_lo, id_hi)
    o = orders.filter(rng).select("order_id", "primary_product_id")
    # non-primary lines per order first, one count per product: a hot order
    # becomes one row, already partitioned on the join key; an order
    # matches max(1, lines) rows in the literal join
    prod = F.col("product_id")
    i = (items.filter(rng & (F.col("is_primary_item") == 0))
         .groupBy("order_id")
         .agg(F.count("order_item_id").alias("n"),
              *[count_if(prod == p).alias(f"n{p}") for p in products]))
    agg = (o.join(i, "order_id", "left")
           .groupBy("primary_product_id")
           .agg((F.count("order_id") if distinct_orders else
                 F.sum(F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(1)))).cast("long").alias("orders"),
                *[F.coalesce(F.sum(f"n{p}"), F.lit(0)).cast("long").alias(f"x_sell_product{p}")
                  for p in products]))
    return agg.select("primary_product_id", "orders",
                      *[f"x_sell_product{p}" for p in products],
                      *[ratio(f"x_sell_product{p}", "orders").alias(f"x_sell_product{p}_rt")
                        for p in products])


def _cart_sessions(pageviews: DataFrame, start, end, split, labels, cart_url):
    """Per (period, session) with cart views in [start, end]: number of cart
    views, whether a pageview followed the first of them, plus the session's
    totals over both periods.  One aggregate over pageviews (by session) and
    a pivot of its two period columns into rows."""
    url, pid = F.col(URL), F.col(PV)
    cart = (url == cart_url) & in_range("created_at", start=start, end=end)
    pre = F.col("created_at") < ts_lit(split)
    ext = (from_first(pageviews, cart).filter(F.col(SID).isNotNull()).groupBy(SID)
           .agg(count_if(cart & pre).alias("m0"), F.min(F.when(cart & pre, pid)).alias("f0"),
                count_if(cart & ~pre).alias("m1"), F.min(F.when(cart & ~pre, pid)).alias("f1"),
                F.max(pid).alias("last_pv")))
    rows = F.explode(F.array(*[
        F.struct(F.lit(labels[i]).alias("time_period"), F.col(f"m{i}").alias("m_sp"),
                 (F.col("last_pv") > F.col(f"f{i}")).alias("clicked"))
        for i in range(2)])).alias("r")
    # periods of the session in which a pageview followed the first cart view
    c_s = (F.when((F.col("m0") > 0) & (F.col("last_pv") > F.col("f0")), 1).otherwise(0)
           + F.when((F.col("m1") > 0) & (F.col("last_pv") > F.col("f1")), 1).otherwise(0))
    return (ext.filter((F.col("m0") > 0) | (F.col("m1") > 0))
            .select(SID, (F.col("m0") + F.col("m1")).alias("m_s"), c_s.alias("c_s"), rows)
            .select(SID, "m_s", "c_s", "r.*")
            .filter(F.col("m_sp") > 0))


def _cart_summary(per: DataFrame, clicks, placed, units, revenue) -> DataFrame:
    agg = per.groupBy("time_period").agg(
        F.count(SID).alias("cart_sessions"),
        F.coalesce(F.sum(clicks), F.lit(0)).cast("long").alias("clickthrough"),
        F.coalesce(F.sum(placed), F.lit(0)).cast("long").alias("orders_placed"),
        F.sum(units).cast("long").alias("products_purchased"),
        sum_money(revenue).alias("revenue"))
    return agg.select(
        "time_period", "cart_sessions", "clickthrough",
        ratio("clickthrough", "cart_sessions").alias("cart_ctr"),
        "orders_placed", "products_purchased",
        ratio("products_purchased", "orders_placed").alias("products_per_order"),
        "revenue", ratio("revenue", "orders_placed").alias("aov"),
        ratio("revenue", "cart_sessions").alias("rev_per_cart_session"))


def cart_pre_post(pageviews: DataFrame, orders: DataFrame, start, end, split,
                  labels: Sequence[str] = ("A. Pre_Cross_Sell", "B. Post_Cross_Sell"),
                  cart_url: str = "/cart") -> DataFrame:
    """Per period: sessions with a cart view in [start, end], how many
    clicked on from the cart, and the orders, units and revenue of the
    sessions that clicked on.  One row per (period, session): no fan-out."""
    per = _cart_sessions(pageviews, start, end, split, labels, cart_url) \
        .join(orders_per_session(orders), SID, "left")
    clicked, has = F.col("clicked"), F.col("n_orders") > 0
    return _cart_summary(per, F.col("clicked").cast("int"),
                         F.when(clicked, F.coalesce("n_orders", F.lit(0))).otherwise(0),
                         F.when(clicked & has, F.col("units")),
                         F.when(clicked & has, F.col("revenue")))


def cart_pre_post_raw(pageviews: DataFrame, orders: DataFrame, start, end, split,
                      labels: Sequence[str] = ("A. Pre_Cross_Sell", "A. Post_Cross_Sell"),
                      cart_url: str = "/cart") -> DataFrame:
    """``cart_pre_post`` with the row multiplication of the literal
    formulation: each cart view row of a session that clicked on is repeated
    once per (period with a click) x (cart view of the session) x (order,
    at least one), and sums run over those rows.  Computed in closed form
    from per-session counts, so the fan-out is never materialised."""
    per = _cart_sessions(pageviews, start, end, split, labels, cart_url) \
        .join(orders_per_session(orders), SID, "left")
    o_s = F.coalesce(F.col("n_orders"), F.lit(0))
    rep = F.col("m_sp") * F.col("c_s") * F.col("m_s")          # 0 when the session never clicked
    active = F.col("c_s") > 0
    has = o_s > 0
    return _cart_summary(per,
                         rep * F.greatest(o_s, F.lit(1)),
                         rep * o_s,
                         F.when(active & has, rep * F.col("units")),
                         F.when(active & has, F.col("revenue") * rep.cast("decimal(20,0)")))


def portfolio_expansion_pre_post(sessions: DataFrame, orders: DataFrame, start, end, split,
                                 labels: Sequence[str] = ("A. Pre_Birthday_Bear",
                                                          "B. Post_Birthday_Bear")) -> DataFrame:
    """Per period (before / from ``split``), sessions in [start, end]:
    sessions, orders, conversion, revenue, units, AOV, units per order,
    revenue per session."""
    s = cohort(sessions, start=start, end=end).select(
        SID, _period("created_at", split, labels).alias("time_period"))
    agg = (with_orders(s, orders).groupBy("time_period")
           .agg(n_sessions().alias("sessions"), n_orders().alias("orders"),
                sum_money("revenue").alias("total_revenue"),
                F.sum("units").cast("long").alias("total_product_sold")))
    return agg.select(
        "time_period", "sessions", "orders", ratio("orders", "sessions").alias("conversion_rt"),
        "total_revenue", "total_product_sold",
        ratio("total_revenue", "orders").alias("avg_order_value"),
        ratio("total_product_sold", "orders").alias("products_per_order"),
        ratio("total_revenue", "sessions").alias("revenue_per_session"))


# --- refunds --------------------------------------------------------------------

def _refunds_per_item(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy("order_item_id").agg(F.count("order_item_refund_id").alias("n_refunds"))


def refund_lookup(items: DataFrame, refunds: DataFrame,
                  order_ids: Sequence[int] | None = None) -> DataFrame:
    """Items (of the given orders, or all) with their refunds (NULL when
    none)."""
    i = items
    if order_ids is not None:
        i = i.filter(F.col("order_id").isin(*order_ids) if order_ids else F.lit(False))
    i = i.select("order_id", "order_item_id",
                 F.col("price_usd").cast("double").alias("price_paid_usd"),
                 F.col("created_at").alias("item_created_at"))
    r = refunds
    if order_ids is not None:
        # a lookup: reduce refunds to the looked-up items first (a semi join
        # the optimizer can broadcast once it has measured the item side)
        r = r.join(i.select("order_item_id"), "order_item_id", "left_semi")
    r = r.select("order_item_id", "order_item_refund_id",
                 F.col("refund_amount_usd").cast("double").alias("refund_amount_usd"),
                 F.col("created_at").alias("refund_created_at"))
    return i.join(r, "order_item_id", "left").select(
        "order_id", "order_item_id", "price_paid_usd", "item_created_at",
        "order_item_refund_id", "refund_amount_usd", "refund_created_at")


def monthly_refund_rate_by_product(items: DataFrame, refunds: DataFrame, before,
                                   products: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Per (year, month) of sale, items sold before ``before``: per product,
    items sold and the share with any refund."""
    j = (items.filter(in_range("created_at", before=before))
         .select("order_item_id", "product_id", "created_at")
         .join(_refunds_per_item(refunds), "order_item_id", "left"))
    prod, refunded = F.col("product_id"), F.col("n_refunds") > 0
    agg = (j.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
           .agg(*[a for p in products for a in (count_if(prod == p).alias(f"p{p}_orders"),
                                                count_if((prod == p) & refunded).alias(f"r{p}"))]))
    cols = ["year", "month"]
    for p in products:
        cols += [f"p{p}_orders", ratio(f"r{p}", f"p{p}_orders").alias(f"p{p}_refund_rt")]
    return agg.select(*cols)


def monthly_refund_summary(items: DataFrame, refunds: DataFrame, start, end,
                           products: Sequence[int] = (1, 2, 3, 4), focus: int = 1) -> DataFrame:
    """Per (year, month) of sale, items sold in [start, end]: items, items
    per product, refunds of the focus product and their rate, all refunds."""
    j = (items.filter(in_range("created_at", start=start, end=end))
         .select("order_item_id", "product_id", "created_at")
         .join(_refunds_per_item(refunds), "order_item_id", "left"))
    prod, nref = F.col("product_id"), F.coalesce(F.col("n_refunds"), F.lit(0))
    agg = (j.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
           .agg(F.count("order_item_id").alias("order_items"),
                *[count_if(prod == p).alias(f"p{p}_orders") for p in products],
                F.sum(F.when(prod == focus, nref).otherwise(0)).cast("long").alias(f"p{focus}_refund"),
                F.sum(nref).cast("long").alias("refunds")))
    return agg.select("year", "month", "order_items", *[f"p{p}_orders" for p in products],
                      f"p{focus}_refund",
                      ratio(f"p{focus}_refund", f"p{focus}_orders").alias(f"p{focus}_refund_rt"),
                      "refunds")


def monthly_refund_count(refunds: DataFrame, items: DataFrame, product: int, start, end) -> DataFrame:
    """Per (year, month) of sale: refunds of one product's items sold in
    [start, end]."""
    i = items.filter(in_range("created_at", start=start, end=end) & (F.col("product_id") == product)) \
        .select("order_item_id", "created_at")
    return (i.join(_refunds_per_item(refunds), "order_item_id", "inner")
            .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
            .agg(F.sum("n_refunds").cast("long").alias("refunds")))
