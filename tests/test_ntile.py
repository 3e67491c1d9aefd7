"""Global NTILE / ROW_NUMBER: equal to the built-in window."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from retentia.operators.ntile import global_ntiles, global_row_number, ntile_from_rank
from retentia.operators.rfm import rfm_base
from retentia.sources.roles import Roles


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 23])
def test_ntile_matches_builtin_with_ties(spark, n):
    rows = [(f"p{k:03d}", k % 3) for k in range(n)]  # heavy ties on the metric
    df = spark.createDataFrame(rows, "pid string, v int")
    order = [F.col("v").desc(), F.col("pid")]
    got = global_ntiles(df, 5, {"b": order}, partitions=3)
    want = df.withColumn("b", F.ntile(5).over(Window.orderBy(*order)))
    assert sorted(map(tuple, got.select("pid", "b").collect())) == \
        sorted(map(tuple, want.select("pid", "b").collect()))


@pytest.mark.parametrize("total", [1, 4, 5, 6, 9, 10, 11, 37])
def test_ntile_formula_bucket_sizes(spark, total):
    df = spark.range(1, total + 1).select(
        ntile_from_rank(F.col("id"), F.lit(total), 5).alias("b"),
        F.ntile(5).over(Window.orderBy("id")).alias("want"))
    assert df.where(F.col("b") != F.col("want")).count() == 0
    sizes = [r[1] for r in df.groupBy("b").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_distributed_row_number_on_rfm_base_equals_builtin(spark):
    r = Roles(spark, SF01)
    base = rfm_base(r.orders, r.customers, r.order_payments)
    order = [F.col("monetary").desc(), F.col("customer_unique_id")]
    got = global_row_number(base, order, "rn", partitions=7)
    want = base.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    g = {row[0]: row[1] for row in got.select("customer_unique_id", "rn").collect()}
    w = {row[0]: row[1] for row in want.select("customer_unique_id", "rn").collect()}
    assert g == w and len(g) > 1000
    assert got.select(F.max("rn_total")).first()[0] == len(g)


def test_distributed_ntiles_on_rfm_base_equal_builtin(spark):
    r = Roles(spark, SF01)
    base = rfm_base(r.orders, r.customers, r.order_payments)
    orders = {"r": [F.col("recency_days").desc(), F.col("customer_unique_id")],
              "f": [F.col("frequency").desc(), F.col("customer_unique_id")]}
    got = global_ntiles(base, 5, orders, partitions=6)
    want = base
    for name, order in orders.items():
        want = want.withColumn(name, F.ntile(5).over(Window.orderBy(*order)))
    cols = ["customer_unique_id", "r", "f"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
