"""Skew: one person owns a third of all orders; every query still matches its oracle.

The hot variant of the sf0.01 data moves every third order to a single person
key (-1). Spark runs the library's queries on it; DuckDB runs the oracle SQL
with the same change to the customers role.
"""

from __future__ import annotations

from functools import cached_property

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from oracle_compare import canon, duck
from retentia.plans import oracle, registry
from retentia.sources.roles import Roles

HOT = -1
_PLAIN = "SELECT o_orderkey AS customer_id, o_custkey AS customer_unique_id,"
_HOT = (f"SELECT o_orderkey AS customer_id, "
        f"CASE WHEN o_orderkey % 3 = 0 THEN {HOT} ELSE o_custkey END AS customer_unique_id,")


class HotRoles(Roles):
    @cached_property
    def customers(self):
        base = super().customers
        return base.withColumn(
            "customer_unique_id",
            F.when(F.col("customer_id") % 3 == 0, F.lit(HOT).cast("long")).otherwise(F.col("customer_unique_id")))


ALL_KEYS = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.fixture(scope="module")
def hot_roles(spark):
    return HotRoles(spark, SF01)


def test_hot_person_holds_a_third(spark, hot_roles):
    c = hot_roles.customers
    n = c.count()
    hot = c.where(F.col("customer_unique_id") == HOT).count()
    assert abs(hot / n - 1 / 3) < 0.01


@pytest.mark.parametrize("key", ALL_KEYS)
def test_query_matches_oracle_under_skew(spark, con, hot_roles, key):
    sql = oracle.oracle_sql()[key]
    assert _PLAIN in sql
    res = con.execute(sql.replace(_PLAIN, _HOT, 1))
    want = canon([d[0] for d in res.description], res.fetchall())
    df = registry.run_on_roles(key, hot_roles)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
