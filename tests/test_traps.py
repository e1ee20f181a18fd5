"""Hand-made cases for the semantic traps, with hand-computed results:
zero divisors, NULL channels, cart fan-out, double refunds, bound styles,
the bounce window mismatch."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest

from handmade import build
from shoplens.operators import channel, products, traffic, users, website

T = dt.datetime.fromisoformat
EMPTY = {"website_sessions": [], "website_pageviews": [], "web_orders": [], "orders": [],
         "order_items": [], "order_item_refunds": []}
GN = ("gsearch", "nonbrand", "https://www.gsearch.com")


def store(spark, **tables):
    s, _ = build(spark, {**EMPTY, **tables}, tempfile.mkdtemp(prefix="shoplens-trap-"))
    return s


def sess(i, at, device="desktop", channel=GN, user=1, repeat=0):
    return (i, T(at), user, repeat, *channel, device)


def order(i, sid, at, price="10.00", items=1):
    p = Decimal(price)
    return (i, T(at), sid, 1, items, p, p * Decimal("0.4000"))


def test_zero_divisors(spark):
    st = store(spark,
               website_sessions=[sess(1, "2024-01-10 10:00", "mobile"), sess(2, "2024-01-10 11:00", "mobile"),
                                 sess(3, "2024-01-10 12:00")],
               website_pageviews=[(1, T("2024-01-10 10:00"), 1, "/home")],
               web_orders=[order(100, 3, "2024-01-10 12:30")])
    rows = {r.device_type: r for r in traffic.conversion_by_device(
        st.sessions, st.web_orders, "2024-01-25", "gsearch", "nonbrand").collect()}
    assert (rows["mobile"].sessions, rows["mobile"].orders, rows["mobile"].conversion_rt) == (2, 0, 0.0)
    assert rows["desktop"].conversion_rt == 1.0
    steps = {"products": "/products", "mrfuzzy": "/the-original-mr-fuzzy"}
    f = website.conversion_funnel(st.sessions, st.pageviews, steps, "2024-01-03", "2024-01-28",
                                  "gsearch", "nonbrand").first()
    assert (f.sessions, f.to_products, f.lander_click_rt, f.products_click_rt) == (3, 0, 0.0, None)


def test_null_channels(spark):
    st = store(spark, website_sessions=[
        sess(1, "2024-01-10", channel=(None, None, None)),
        sess(2, "2024-01-10", channel=(None, None, "https://elsewhere.example")),
        sess(3, "2024-01-10", channel=(None, None, "https://www.bsearch.com")),
        sess(4, "2024-01-10", channel=("socialbook", "pilot", "https://www.socialbook.com"))])
    kinds = {r.type_of_traffic: r.sessions for r in channel.referrer_traffic_type(st.sessions).collect()}
    assert kinds == {"direct_type_in": 1, "others": 2, "bsearch_organic": 1}
    mix = channel.monthly_channel_group_mix(st.sessions, "2024-01-25").first()
    assert (mix.nonbrand, mix.brand, mix.direct, mix.organic) == (0, 0, 1, 1)
    assert mix.direct_percent_of_nonbrand is None
    groups = {r.channel_group: r.new_sessions for r in
              users.channel_new_vs_repeat(st.sessions, "2024-01-01", "2024-01-28").collect()}
    assert groups == {"direct_type_in": 1, "organic_search": 1, "paid_social": 1, None: 1}


def test_cart_fan_out(spark):
    """Two cart views, a later page and two orders in one session: the
    literal joins give 2 (views) x 1 (click period) x 2 (views) x 2 (orders)
    rows; the per-session form counts the session once."""
    pv = [(1, T("2024-01-10 10:00"), 7, "/cart"), (2, T("2024-01-10 10:01"), 7, "/cart"),
          (3, T("2024-01-10 10:02"), 7, "/shipping")]
    st = store(spark, website_sessions=[sess(7, "2024-01-10 10:00")], website_pageviews=pv,
               web_orders=[order(100, 7, "2024-01-10 10:03", "10.00", 2),
                           order(101, 7, "2024-01-10 10:04", "5.00", 1)])
    raw = products.cart_pre_post_raw(st.pageviews, st.web_orders, "2024-01-03", "2024-01-28",
                                     "2024-01-15").first()
    assert (raw.cart_sessions, raw.clickthrough, raw.orders_placed, raw.products_purchased,
            raw.revenue) == (1, 8, 8, 12, 60.0)
    one = products.cart_pre_post(st.pageviews, st.web_orders, "2024-01-03", "2024-01-28",
                                 "2024-01-15").first()
    assert (one.cart_sessions, one.clickthrough, one.orders_placed, one.products_purchased,
            one.revenue, one.aov) == (1, 1, 2, 3, 15.0, 7.5)


def test_double_refund(spark):
    items = [(1, 10, 1, 1, Decimal("9.00"), T("1999-01-05")), (2, 10, 1, 0, Decimal("9.00"), T("1999-01-06"))]
    refunds = [(1, 1, Decimal("9.00"), T("1999-01-09")), (2, 1, Decimal("1.00"), T("1999-01-10"))]
    st = store(spark, order_items=items, order_item_refunds=refunds)
    rate = products.monthly_refund_rate_by_product(st.items, st.refunds, "2000-10-15").first()
    assert (rate.p1_orders, rate.p1_refund_rt) == (2, 0.5)          # refunded items
    summ = products.monthly_refund_summary(st.items, st.refunds, "1998-09-30", "1999-10-15").first()
    assert (summ.p1_refund, summ.p1_refund_rt, summ.refunds) == (2, 1.0, 2)   # refund ids
    cnt = products.monthly_refund_count(st.refunds, st.items, 1, "1998-09-30", "1999-10-15").first()
    assert cnt.refunds == 2


def test_bound_styles(spark):
    """BETWEEN includes its end instant; an open bound excludes it."""
    st = store(spark, website_sessions=[sess(1, "2024-01-28 00:00:00"), sess(2, "2024-01-03 00:00:00")])
    p = products.portfolio_expansion_pre_post(st.sessions, st.web_orders, "2024-01-03", "2024-01-28",
                                              "2024-01-15").collect()
    assert sum(r.sessions for r in p) == 2
    m = channel.mobile_share_by_source(st.sessions, "2024-01-03", "2024-01-28", "nonbrand").collect()
    assert m == []


def test_bounce_counts_pageviews_past_the_window(spark):
    """The landing page is taken before the cutoff, the bounce count is not:
    a second pageview after the cutoff means no bounce."""
    pv = [(1, T("2024-01-19 23:50"), 1, "/home"), (2, T("2024-01-20 00:10"), 1, "/products"),
          (3, T("2024-01-19 10:00"), 2, "/home")]
    st = store(spark, website_sessions=[sess(1, "2024-01-19 23:50"), sess(2, "2024-01-19 10:00")],
               website_pageviews=pv)
    r = website.bounce_rate(st.pageviews, "2024-01-20").first()
    assert (r.total_sessions, r.bounced_sessions, r.bounce_rate) == (2, 1, 0.5)


@pytest.mark.parametrize("raw", [False, True])
def test_weekly_landing_null_week(spark, raw):
    """Raw form keeps sessions outside the cohort as a NULL week."""
    pv = [(1, T("2024-01-10 10:00"), 1, "/home"), (2, T("2024-01-10 10:00"), 2, "/lander-1")]
    st = store(spark, website_sessions=[sess(1, "2024-01-10 10:00"),
                                        sess(2, "2024-01-10 10:00", channel=("bsearch", "brand", None))],
               website_pageviews=pv)
    fn = website.weekly_landing_trend_raw if raw else website.weekly_landing_trend
    weeks = {r.year_week: r for r in fn(st.sessions, st.pageviews, "2024-01-03", "2024-01-28",
                                        "gsearch", "nonbrand").collect()}
    assert weeks[202401].total_sessions == 1 and weeks[202401].home_sessions == 1
    assert (None in weeks) == raw
    if raw:
        assert (weeks[None].total_sessions, weeks[None].bounce_sessions) == (1, 0)


def test_time_to_repeat_makes_no_pairs(spark):
    """A thousand new and a thousand repeat sessions of one user: no operator
    puts out more rows than there are sessions."""
    import random
    rng = random.Random(1)
    t0 = T("2024-01-01")
    rows = [(i, t0 + dt.timedelta(minutes=rng.randrange(30_000)), 1, i % 2, *GN, "desktop") for i in range(2000)]
    st = store(spark, website_sessions=rows)
    days = []
    for i, at, _, rep, *_ in rows:
        later = [r[1] for r in rows if r[0] > i and r[3] == 1 and r[1] < T("2024-01-25")]
        if rep == 0 and at < T("2024-01-25") and later:
            days.append((min(later).date() - at.date()).days)
    for bucket in (users.ID_BUCKET, 7, 500):
        df = users.time_to_repeat(st.sessions, "2024-01-01", "2024-01-25", id_bucket=bucket)
        got = df.first()
        assert (got.min_days_first_to_second, got.max_days_first_to_second) == (min(days), max(days))
        assert abs(got.avg_days_first_to_second - sum(days) / len(days)) < 1e-9
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert all("bucket" in x for x in joins)  # a row per bucket on one side


def test_three_sources_have_two_ratios(spark):
    st = store(spark, website_sessions=[
        sess(1, "2024-01-10"), sess(2, "2024-01-10", channel=("bsearch", "nonbrand", None)),
        sess(3, "2024-01-10", channel=("socialbook", "nonbrand", None)), sess(4, "2024-01-10")])
    r = channel.weekly_source_device_pivot(st.sessions, "2024-01-03", "2024-01-28", "nonbrand",
                                           {"g": "gsearch", "b": "bsearch", "s": "socialbook"}).first()
    assert (r.b_percentage_of_g_desktop, r.s_percentage_of_g_desktop) == (0.5, 0.5)


def test_time_parameters_must_be_times(spark):
    from shoplens.functions.metrics import in_range
    with pytest.raises(ValueError):
        in_range("created_at", before="2024-01-01' OR TRUE --")
