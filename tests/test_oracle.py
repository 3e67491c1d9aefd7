"""Differential test: every registered query against its DuckDB oracle at sf0.01."""

from __future__ import annotations

import pytest

from conftest import SF01
from oracle_compare import compare, duck
import __spark_entry__ as E


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", sorted(k for k in E.queries() if not k.startswith("op") and k != "pipeline"))
def test_query_matches_oracle(spark, con, key):
    assert key in E.oracle_sql(), f"{key} has no oracle"
    assert compare(spark, key, SF01, con, verbose=False)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["purchase_month", "total_orders", "monthly_revenue",
                          "avg_order_value", "revenue_growth_pct"]
    assert df.count() > 0


@pytest.mark.parametrize("key", ["executive_summary", "rfm_hybrid", "handoff_by_segment",
                                 "category_repeat_rate_ranked", "second_purchase_stats"])
def test_lazy_roles_match_oracle(spark, con, key):
    """Same results when the role tables are derived inside the query instead of materialized."""
    spark.conf.set("retentia.roles.materialize", "false")
    try:
        assert compare(spark, key, SF01, con, verbose=False)
    finally:
        spark.conf.unset("retentia.roles.materialize")
