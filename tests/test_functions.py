"""Scalar semantics: the PostgreSQL traps listed in the blueprint."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import ts
from retentia.functions import (
    date_days_between, epoch_days_between, extract_days_between, nullif_blank, pct,
    pg_concat_ws, pg_initcap, ratio, round_half,
)


def test_pg_initcap_starts_words_after_any_non_alphanumeric(spark):
    df = spark.createDataFrame([("  D'oeste-do sul ",), ("embu-guacu",), ("são paulo",),
                                ("RIO DE JANEIRO",), (None,)], "x string")
    got = [r[0] for r in df.select(pg_initcap(F.trim("x"))).collect()]
    assert got == ["D'Oeste-Do Sul", "Embu-Guacu", "São Paulo", "Rio De Janeiro", None]


def test_round_half_matches_integer_rounding_rule(spark):
    df = spark.createDataFrame([(0.145,), (2.675,), (-2.5,), (12.125,), (None,)], "x double")
    got = [r[0] for r in df.select(round_half("x", 2)).collect()]
    # round(x * 100) / 100 on the double value: 0.145 is 0.14499999... in binary
    assert got == [0.14, 2.68, -2.5, 12.13, None]  # 2.675 * 100 is exactly 267.5
    assert [r[0] for r in df.select(round_half("x", 0)).collect()][:3] == [0.0, 3.0, -3.0]


def test_ratio_and_pct_are_null_on_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (2, 3)], "a long, b long")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, 0.33, 0.67]
    assert [r[0] for r in df.select(pct("a", "b")).collect()] == [None, 33.33, 66.67]


def test_concat_skips_nulls_like_postgres(spark):
    df = spark.createDataFrame([(5, None, 1)], "r int, f int, m int")
    assert df.select(pg_concat_ws("-", "r", "f", "m")).first()[0] == "5-1"


def test_nullif_blank(spark):
    df = spark.createDataFrame([("",), ("  ",), (" 4 ",), (None,)], "x string")
    assert [r[0] for r in df.select(nullif_blank("x")).collect()] == [None, None, "4", None]


def test_day_arithmetic_late_by_hours(spark):
    """Delivered 20 h after the estimate: 0 whole days late, yet late."""
    df = spark.createDataFrame([
        (ts("2018-01-10 20:00:00"), ts("2018-01-10 00:00:00")),
        (ts("2018-01-08 01:00:00"), ts("2018-01-10 00:00:00")),   # 1 d 23 h early
        (None, ts("2018-01-10 00:00:00")),
    ], "delivered timestamp_ntz, estimated timestamp_ntz")
    rows = df.select(extract_days_between("delivered", "estimated").alias("d"),
                     (F.col("delivered") > F.col("estimated")).alias("late"),
                     date_days_between("delivered", "estimated").alias("cal")).collect()
    assert [(r.d, r.late, r.cal) for r in rows] == [(0, True, 0), (-1, False, -2), (None, None, None)]


def test_epoch_days_is_fractional(spark):
    df = spark.createDataFrame([(ts("2018-01-01 00:00:00"), ts("2018-01-02 12:00:00"))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(epoch_days_between("b", "a")).first()[0] == 1.5


def test_percentile_from_histogram_equals_percentile_cont(spark):
    import random
    from retentia.functions import percentile_from_histogram
    rnd = random.Random(7)
    for _ in range(20):
        counts = [rnd.choice([0, 0, 1, 2, 5, 9]) for _ in range(5)]
        if sum(counts) == 0:
            continue
        rows = [(v,) for v, c in zip(range(1, 6), counts) for _ in range(c)]
        want = spark.createDataFrame(rows, "x int").agg(
            F.percentile("x", 0.5).alias("m"), F.percentile("x", 0.9).alias("q")).first()
        wide = spark.createDataFrame([tuple(counts)], "c1 long, c2 long, c3 long, c4 long, c5 long")
        cols = ["c1", "c2", "c3", "c4", "c5"]
        got = wide.select(percentile_from_histogram([1, 2, 3, 4, 5], cols, 0.5).alias("m"),
                          percentile_from_histogram([1, 2, 3, 4, 5], cols, 0.9).alias("q")).first()
        assert abs(got.m - want.m) < 1e-9 and abs(got.q - want.q) < 1e-9, counts


def test_round_half_never_returns_negative_zero(spark):
    import math
    df = spark.createDataFrame([(-0.001,), (-0.004,)], "x double")
    for v in (r[0] for r in df.select(round_half("x", 2)).collect()):
        assert v == 0.0 and math.copysign(1.0, v) == 1.0
