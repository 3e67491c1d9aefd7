"""Data-quality operators on hand-made rows with seeded violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import order, roles
from retentia.operators import quality as dq


def test_duplicate_rows_counts_null_keys_as_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3), (2, 4)], "a int, b int")
    r = dq.duplicate_rows(df, ["a", "b"]).first()
    assert (r.total_rows, r.total_duplicate_rows) == (5, 2)
    k = dq.composite_key_check(df, ["a", "b"]).first()
    assert (k.total_rows, k.distinct_keys) == (5, 3)


def test_dup_keys_and_primary_key(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 5)], "k string, v int")
    assert sorted(map(tuple, dq.dup_keys(df, ["k"]).collect())) == [("x", 2)]
    pk = set(map(tuple, dq.primary_key_violations(df, ["k"]).collect()))
    assert pk == {(None, 1), ("x", 2)}


def test_orphans_equal_left_join_is_null(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (3,)], "pk int")
    got = dq.orphan_audit([("child.k", child, "k", parent, "pk")]).first()
    lj = child.join(parent, child.k == parent.pk, "left").where(parent.pk.isNull()).count()
    assert got.orphans == lj == 3
    assert dq.foreign_key_violations(child, "k", parent, "pk").count() == 2  # NULL key is no FK violation


def test_constraint_checks(spark):
    df = spark.createDataFrame([(1, "SP", -1.0), (6, "SPX", 2.0), (None, None, 0.0)],
                               "score int, state string, price double")
    got = {r.constraint: r.violations for r in dq.check_constraints(
        df, not_null=["state"], non_negative=["price"], between=[("score", 1, 5)],
        max_length=[("state", 2)], table="t").collect()}
    assert got == {"not_null(state)": 1, "non_negative(price)": 1, "between(score,1,5)": 1,
                   "max_length(state,2)": 1}


def _payments_split(spark):
    orders = [order("o1", "u1", purchase="2018-01-01 10:00:00"),
              order("o2", "u2", purchase="2018-01-02 10:00:00"),
              order("o3", "u3", purchase="2018-01-03 10:00:00"),
              order("o4", "u4", purchase="2018-01-04 10:00:00"),
              order("o5", "u5", status="canceled", purchase="2018-01-05 10:00:00")]
    payments = [("o1", 1, "voucher", 1, 20.00), ("o1", 2, "credit_card", 3, 81.00),
                ("o3", 1, "boleto", 1, 101.00), ("o4", 1, "credit_card", 10, 101.01)]
    items = [("o1", 1, "p1", "s1", "2018-01-05 00:00:00", 90.00, 10.00),
             ("o3", 1, "p1", "s1", "2018-01-05 00:00:00", 90.00, 10.00),
             ("o4", 1, "p1", "s1", "2018-01-05 00:00:00", 90.00, 10.00)]
    return roles(spark, orders, payments, items)


def test_reconciliation_tolerance_edges(spark):
    o, c, p, i, *_ = _payments_split(spark)
    got = {r.order_id: r for r in dq.payment_reconciliation_voucher(i, p, 1.00).collect()}
    # o1 differs by exactly 1.00 -> kept out; o4 by 1.01 -> in
    assert set(got) == {"o4"} and str(got["o4"].discrepancy) == "1.01"
    assert got["o4"].voucher_count == 0
    byi = dq.discrepancy_by_installments(i, p, 1.00).collect()
    assert [(r.payment_installments, r.order_count, r.avg_discrepancy) for r in byi] == [(10, 1, 1.01)]


def test_multi_method_ghost_and_without_items(spark):
    o, c, p, i, *_ = _payments_split(spark)
    assert sorted(r.payment_type for r in dq.multi_method_payments(p).collect()) == ["credit_card", "voucher"]
    assert [r.order_id for r in dq.ghost_orders(o, i).collect()] == ["o2"]
    got = {r.order_status: r.total_orders for r in dq.orders_without_items_by_status(o, i).collect()}
    assert got == {"delivered": 1, "canceled": 1}


def test_null_audit_and_impossible_dates(spark):
    o, c, *_ = _payments_split(spark)
    o2 = o.union(spark.createDataFrame([("o9", "c-o9", "delivered", None, None, None, None)], o.schema))
    got = {(r.table_name, r.column_name): r.nulls for r in dq.null_audit(
        {"orders": (o2, ["order_id", "order_purchase_timestamp"])}).collect()}
    assert got == {("orders", "order_id"): 0, ("orders", "order_purchase_timestamp"): 1}
    # o1 before the lower bound; o4 and o5 after "now"
    assert dq.impossible_dates(o, lower="2018-01-02", as_of="2018-01-04").first().rows == 3


def test_shared_reviews(spark):
    o, *_ = _payments_split(spark)
    r = spark.createDataFrame([("r1", "o1", 5, "a"), ("r1", "o2", None, "b"), ("r2", "o3", 4, None)],
                              "review_id string, order_id string, review_score int, review_comment_message string")
    got = dq.shared_reviews(r).collect()
    assert [(x.review_id, x.order_id, x.review_score) for x in got] == [("r1", "o1", 5), ("r1", "o2", None)]
    assert dq.value_range(r, "review_score").select(F.col("min"), F.col("max")).first() == (4, 5)
