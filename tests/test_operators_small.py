"""Analytics operators on hand-made role tables (edge cases of the reference semantics)."""

from __future__ import annotations

from decimal import Decimal

from conftest import order, roles
from retentia.operators import churn as ch
from retentia.operators import revenue as rv
from retentia.operators import rfm
from retentia.operators import rootcause as rc


def _same_day(spark):
    """u1: two orders on one day, a third 75 days later; u2 one order; u3..u6 at 75/76/150/151 days."""
    orders = [
        order("a1", "u1", purchase="2018-01-01 09:00:00"),
        order("a2", "u1", purchase="2018-01-01 18:00:00"),
        order("a3", "u1", purchase="2018-03-17 10:00:00"),
        order("b1", "u2", purchase="2018-05-01 10:00:00"),
        order("c1", "u3", purchase="2018-05-31 10:00:00"),
        order("c2", "u3", purchase="2018-06-05 10:00:00"),
        order("d1", "u4", purchase="2018-05-31 12:00:00"),
        order("e1", "u5", purchase="2018-03-16 10:00:00"),
        order("f1", "u6", purchase="2018-03-15 10:00:00"),
        order("z1", "u9", status="canceled", purchase="2018-08-14 10:00:00"),  # snapshot from all statuses
    ]
    payments = [(r[0][0], 1, "credit_card", 1, 10.0) for r in orders]
    return roles(spark, orders, payments)


def test_second_purchase_gap_same_day_is_zero(spark):
    o, c, *_ = _same_day(spark)
    gaps = {r.customer_unique_id: r.days_between_orders for r in ch.second_purchase_gap(o, c).collect()}
    assert gaps == {"u1": 0, "u3": 5}
    s1 = ch.second_purchase_stats(o, c).first()
    s2 = ch.second_purchase_stats(o, c, min_gap=1).first()
    assert (s1.customers_with_second_purchase, s1.min_days, s1.max_days, s1.median_days) == (2, 0, 5, 2.5)
    assert s2.customers_with_second_purchase == 1
    x3 = ch.same_day_repeat_share(o, c).first()
    assert (x3.repeaters, x3.same_day, x3.same_day_pct) == (2, 1, 50.0)
    assert s1.customers_with_second_purchase - s2.customers_with_second_purchase == x3.same_day


def test_churn_thresholds_are_inclusive(spark):
    o, c, *_ = _same_day(spark)
    # snapshot 2018-08-14: u4 75 days, u3 70, u2 105, u5 151, u6 152, u1 150
    got = {r.customer_status: r.customers for r in ch.churn_status(o, c).collect()}
    assert got == {"Active": 2, "At Risk": 2, "Likely Churned": 2}


def test_purchase_windows_labels(spark):
    assert ch.window_labels((7, 30, 90, 180)) == ["0-7 days", "8-30 days", "31-90 days",
                                                  "91-180 days", "180+ days"]
    o, c, *_ = _same_day(spark)
    got = [(r.purchase_window, r.helper, r.customers) for r in ch.purchase_windows(o, c).collect()]
    assert got == [("0-7 days", 1, 1)]


def _gap_month(spark):
    orders = [order("m1", "u1", purchase="2017-01-10 10:00:00"),
              order("m2", "u2", purchase="2017-03-05 10:00:00"),
              order("m3", "u3", purchase="2017-04-05 10:00:00"),
              order("m4", "u4", purchase="2017-04-06 10:00:00")]
    payments = [("m1", 1, "voucher", 1, 100.0), ("m2", 1, "boleto", 1, 0.0), ("m3", 1, "boleto", 1, 30.0)]
    return roles(spark, orders, payments)


def test_monthly_trends_lag_skips_missing_month_and_zero_revenue(spark):
    o, c, p, *_ = _gap_month(spark)
    rows = [tuple(r) for r in rv.monthly_trends(o, p).orderBy("purchase_month").collect()]
    assert [(str(r[0]), r[1], r[2], r[4]) for r in rows] == [
        ("2017-01-01", 1, Decimal("100.00"), None),
        ("2017-03-01", 1, Decimal("0.00"), -100.0),   # previous *existing* month
        ("2017-04-01", 2, Decimal("30.00"), None),    # growth from zero is NULL
    ]
    # the unpaid April order counts as an order in the trend but not in the summary
    es = rv.executive_summary(o, c, p).first()
    assert (es.total_orders, es.total_unique_customers, es.total_revenue) == (3, 3, Decimal("130.00"))


def test_pareto_label_uses_rounded_cumulative_share(spark):
    # AA holds 80.004 % of revenue: above 80 unrounded, 80.00 once rounded -> top segment
    orders, payments = [], []
    for k, (st, value) in enumerate([("AA", 8000.4), ("BB", 1999.2), ("CC", 0.4)]):
        orders.append(order(f"o{k}", f"u{k}", purchase="2018-01-01 10:00:00", state=st))
        payments.append((f"o{k}", 1, "boleto", 1, value))
    o, c, p, *_ = roles(spark, orders, payments)
    got = {r.state: (r.cumulative_revenue_pct, r.pareto_segment) for r in rv.state_pareto(o, c, p).collect()}
    assert got["AA"] == (80.0, "Top 80% Revenue Drivers")
    assert got["BB"] == (100.0, "Long Tail")


def test_delivery_late_by_hours(spark):
    orders = [order("o1", "u1", purchase="2018-01-01 00:00:00", delivered="2018-01-10 20:00:00",
                    estimated="2018-01-10 00:00:00"),
              order("o2", "u1", purchase="2018-01-01 00:00:00", delivered="2018-01-08 01:00:00",
                    estimated="2018-01-10 00:00:00"),
              order("o3", "u2", purchase="2018-01-01 00:00:00", delivered=None, estimated="2018-01-10 00:00:00")]
    o, c, *_ = roles(spark, orders)
    got = {r.customer_group: r for r in rc.delivery_one_time_vs_repeat(o, c).collect()}
    assert set(got) == {"Repeat (3%)"}  # u2's only order has no delivery date
    r = got["Repeat (3%)"]
    assert (r.total_orders, r.late_deliveries, r.avg_delay_when_late, r.late_delivery_pct) == (2, 1, 0.0, 50.0)
    assert (r.avg_actual_delivery_days, r.avg_estimated_delivery_days) == (8.0, 9.0)


def test_freight_zero_price_and_reviews_null_score(spark):
    orders = [order("o1", "u1", purchase="2018-01-01 00:00:00"),
              order("o2", "u1", status="canceled", purchase="2018-01-02 00:00:00"),
              order("o3", "u2", purchase="2018-01-03 00:00:00")]
    items = [("o1", 1, "p1", "s", "2018-01-02 00:00:00", 0.00, 5.00),
             ("o1", 2, "p1", "s", "2018-01-02 00:00:00", 10.00, 5.00),
             ("o3", 1, "p1", "s", "2018-01-02 00:00:00", 20.00, 2.00)]
    reviews = [("r1", "o1", 5, None), ("r1", "o3", None, None), ("r2", "o3", 1, None)]
    o, c, p, i, r, *_ = roles(spark, orders, items=items, reviews=reviews)
    fb = {x.group_type: x for x in rc.freight_burden(i, o, c).collect()}
    # u1 has two orders of any status -> repeater; price 0 is left out of the ratio only
    assert fb["3% Repeaters"].total_orders == 2 and fb["3% Repeaters"].freight_as_pct_of_price == 50.0
    assert fb["97% One-Timers"].freight_as_pct_of_price == 10.0
    rev = {x.customer_type: x for x in rc.reviews_one_time_vs_repeat(o, c, r).collect()}
    one = rev["One-Time Buyer (97%)"]
    assert (one.total_customers, one.total_orders, one.orders_with_reviews, one.total_reviews) == (2, 2, 2, 2)
    assert (one.avg_review_score, one.median_review_score, one.pct_5_star, one.negative_reviews) == (3.0, 3.0, 50.0, 1)


def test_rfm_hybrid_rules_and_priority(spark):
    orders, payments = [], []
    # 7 repeat persons with growing frequency and spend; u7 has 5 orders -> Champions by frequency
    for u in range(1, 8):
        n = 2 if u < 7 else 5
        for k in range(n):
            oid = f"o{u}_{k}"
            orders.append(order(oid, f"u{u}", purchase=f"2018-0{1 + (u % 8)}-1{k} 10:00:00"))
            payments.append((oid, 1, "boleto", 1, 10.0 * u))
    o, c, p, *_ = roles(spark, orders, payments)
    got = {r.customer_unique_id: r for r in rfm.rfm_hybrid(o, c, p).collect()}
    assert len(got) == 7
    assert got["u7"].segment == "Champions" and got["u7"].action_priority == 1
    prio = {"Champions": 1, "Active & Engaged": 2, "Lapsed - Recovery Target": 3,
            "Active - Needs Nurturing": 4, "Churned": 5}
    assert all(prio[r.segment] == r.action_priority for r in got.values())
    summary = {r.segment: r.customers for r in rfm.rfm_segment_summary(rfm.rfm_hybrid(o, c, p)).collect()}
    assert sum(summary.values()) == 7


def test_approximate_gap_percentiles_return_observed_values(spark):
    o, c, *_ = _same_day(spark)
    exact = ch.second_purchase_stats(o, c).first()
    approx = ch.second_purchase_stats(o, c, accuracy=10000).first()
    assert exact.median_days == 2.5                  # interpolated between 0 and 5
    assert approx.median_days in (0.0, 5.0)          # an observed gap
    assert (approx.customers_with_second_purchase, approx.min_days, approx.max_days) == (2, 0, 5)


def test_multi_order_customers_array_form_matches_rows(spark):
    orders = [order("x1", "u1", purchase="2018-01-03 10:00:00"),
              order("x2", "u1", purchase="2018-01-01 10:00:00"),
              order("x3", "u1", purchase="2018-01-02 10:00:00"),
              order("y1", "u2", purchase="2018-01-05 10:00:00"),
              order("y2", "u2", purchase="2018-01-04 10:00:00"),
              order("z1", "u3", purchase="2018-01-04 10:00:00")]
    o, c, *_ = roles(spark, orders)
    rows = rv.multi_order_customers(o, c, limit=10).collect()
    seq = {(r.customer_unique_id, r.order_seq): r.order_id for r in rows}
    assert seq == {("u1", 1): "x2", ("u1", 2): "x3", ("u1", 3): "x1", ("u2", 1): "y2", ("u2", 2): "y1"}
    arrays = {r.customer_unique_id: (r.total_orders, list(r.order_ids))
              for r in rv.multi_order_customers(o, c, limit=10, as_array=True).collect()}
    assert arrays == {"u1": (3, ["x2", "x3", "x1"]), "u2": (2, ["y2", "y1"])}
    top1 = rv.multi_order_customers(o, c, limit=1).collect()
    assert {r.customer_unique_id for r in top1} == {"u1"}


def test_rfm_classic_orientation(spark):
    orders, payments = [], []
    for u in range(1, 11):
        for k in range(u):  # person u has u orders worth 10*u each
            oid = f"o{u}_{k}"
            orders.append(order(oid, f"u{u:02d}", purchase=f"2018-01-{10 + k:02d} 10:00:00"))
            payments.append((oid, 1, "boleto", 1, 10.0 * u))
    o, c, p, *_ = roles(spark, orders, payments)
    ref = {r.customer_unique_id: r for r in rfm.rfm_classic(o, c, p, limit=None).collect()}
    best = {r.customer_unique_id: r for r in rfm.rfm_classic(o, c, p, limit=None, higher_is_better=True).collect()}
    # the reference orders f and m DESC, so the most frequent, biggest spender gets 1
    assert (ref["u10"].f_score, ref["u10"].m_score) == (1, 1)
    assert (best["u10"].f_score, best["u10"].m_score) == (5, 5)
    assert ref["u10"].rfm_segment == f"{ref['u10'].r_score}-1-1"


def test_impossible_dates_defaults_to_now(spark):
    o, *_ = _gap_month(spark)
    assert rv_impossible(o) == 0


def rv_impossible(o):
    from retentia.operators.quality import impossible_dates
    return impossible_dates(o, lower="2017-01-01").first().rows


def test_handoff_sums_beyond_long(spark):
    """30 orders of one person, each handed over 9998 years later: more microseconds than a long holds."""
    orders = [order(f"a{k}", "u1", purchase="0001-01-01", carrier="9999-01-01") for k in range(30)]
    orders += [order("b", "u2", purchase="2018-01-01", carrier="2018-01-03")]
    o, c, *_ = roles(spark, orders)
    days = 3651694.0
    got = {r.group_type: (r.total_orders, r.avg_handoff_days, r.pct_within_3_days) for r in rc.handoff_one_time_vs_repeat(o, c).collect()}
    assert got == {"3% Repeaters": (30, days, 0.0), "97% One-Timers": (1, 2.0, 100.0)}
    segments = spark.createDataFrame([("u1", "s"), ("u2", "s")], "customer_unique_id string, segment string")
    row = rc.handoff_by_segment(o, c, None, segments=segments).first()
    assert (row.total_orders, row.avg_handoff_days, row.worst_case_handoff) == (31, round((30 * days + 2) / 31, 2), days)
