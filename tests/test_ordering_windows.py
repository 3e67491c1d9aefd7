"""Global running totals, ranks and paged arrays against the built-in window in one partition."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia.operators.ordering import global_rank, ordered_pages, running_total


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module", params=["spread", "ties", "one value", "nulls"])
def data(request, spark):
    rng = random.Random(1)
    values = {"spread": lambda k: rng.randint(0, 10**6), "ties": lambda k: min(3, rng.randint(0, 9)), "one value": lambda k: 5,
              "nulls": lambda k: rng.choice([None, None, 1, 2])}[request.param]
    return spark.createDataFrame([(k, values(k), rng.randint(-5, 9)) for k in range(400)], "id int, m int, x long").repartition(3)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("descending", [True, False])
def test_rank(data, parts, descending):
    order = F.col("m").desc_nulls_last() if descending else F.col("m").asc_nulls_last()
    want = data.withColumn("rank", F.rank().over(Window.orderBy(order)).cast("long"))
    got = global_rank(data, "m", ["id"], descending=descending, partitions=parts)
    assert got.columns == want.columns and rows(got.withColumn("rank", F.col("rank").cast("long"))) == rows(want)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_total(data, parts):
    order = [F.col("m").desc_nulls_last(), F.col("id")]
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = data.withColumn("t", F.sum("x").over(window)).withColumn("t_total", F.sum("x").over(Window.partitionBy()))
    assert rows(running_total(data, order, "x", "t", parts)) == rows(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, m int, x long")
    assert global_rank(empty, "m", ["id"]).count() == 0 and running_total(empty, [F.col("id")], "x", "t").count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pages_of_a_hot_person(spark, size):
    rng = random.Random(2)
    data = [("hot" if k % 3 else f"p{k % 40}" if k % 5 else None, None if k % 50 == 0 else f"2018-01-{rng.randint(1, 9):02d} 0{rng.randint(0, 9)}:00:00", k) for k in range(500)]
    df = spark.createDataFrame(data, "person string, at string, id int").withColumn("at", F.col("at").cast("timestamp_ntz")).repartition(5)
    got = ordered_pages(df, ["person"], "at", "id", size).collect()
    assert all(1 <= len(r["values"]) <= size for r in got)
    for person in {d[0] for d in data}:
        want = [i for _, _, i in sorted(((t is None, t or "", i) for p, t, i in data if p == person))]
        pages = sorted((r for r in got if r["person"] == person), key=lambda r: r["page"])
        assert [r["page"] for r in pages] == list(range(len(pages)))
        assert [i for r in pages for i in r["values"]] == want
