"""The materialized role layer: what is written, and in how many shuffles."""

from __future__ import annotations

import os

from conftest import SF001
from oracle_compare import canon, duck
from pyspark.sql import DataFrameWriter
from retentia.plans import oracle
from retentia.plans.registry import run_on_roles
from retentia.sources.roles import CONF_BUCKETS, ORDER_KEYED, MaterializedRoles, SpreadRoles, bucket_count


def test_only_the_tables_read_are_written(spark):
    roles = MaterializedRoles.build(spark, SF001 + "/")
    roles.root, roles.tag = roles.root + "-lazy", roles.tag + "_lazy"  # a layer of its own
    local = roles.root.removeprefix("file:")
    assert run_on_roles("impossible_dates", roles).count() == 1
    assert set(os.listdir(local)) == {"orders"}
    run_on_roles("state_pareto", roles).collect()
    assert set(os.listdir(local)) == {"orders", "customers", "order_payments"}


def test_order_keyed_tables_shuffle_each_input_once(spark):
    """Lines and orders are spread by order key; windows, aggregates and the buckets add no other shuffle."""
    roles = SpreadRoles(spark, SF001, 7)
    for name, inputs in (("order_items", 1), ("order_payments", 1), ("orders", 3)):
        plan = getattr(roles, name).repartition(7, "order_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == inputs, plan
        assert name in ORDER_KEYED


def test_buckets_are_small(spark):
    """Estimated at 80 MB; one task used to sort a bucket of up to 256 MB of Parquet, and spilled."""
    lines = spark.range(4_000_000).selectExpr("id AS order_id", "id AS order_item_id", "id AS product_id", "id AS seller_id")
    assert bucket_count(spark, lines) >= 10


def test_raw_counts_shuffle_each_input_once(spark, monkeypatch):
    """The tables that raw_cleaned_counts stores: as many shuffles as inputs by order key, and the SQL's rows."""
    shuffles = {}
    save = DataFrameWriter.saveAsTable

    def spy(writer, name, *args, **kwargs):
        plan = writer._df._jdf.queryExecution().executedPlan().toString()
        shuffles[next(t for t in ORDER_KEYED if name.endswith(f"_{t}"))] = plan.count("Exchange hashpartitioning")
        return save(writer, name, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", spy)
    spark.conf.set(CONF_BUCKETS, "7")  # other than the shuffle partitions
    try:
        roles = MaterializedRoles.build(spark, SF001 + "/")
        roles.root, roles.tag = roles.root + "-raw", getattr(roles, "tag", "") + "_raw"  # a layer of its own
        df = run_on_roles("raw_cleaned_counts", roles)
        got = canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.unset(CONF_BUCKETS)
    # lines once; orders three times (their rows, the dates for the lines, their persons) beside the lines
    assert shuffles == {"orders": 4, "order_items": 1, "order_payments": 1, "order_reviews": 1}
    res = duck(SF001).execute(oracle.oracle_sql()["raw_cleaned_counts"])
    assert got == canon([d[0] for d in res.description], res.fetchall())
