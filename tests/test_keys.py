"""All constraints in one shuffle, against the one-by-one operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import SF001
from retentia.operators.keys import KeyAudit, column_checks
from retentia.operators.quality import check_constraints, dup_keys, foreign_key_violations, orphan_audit, primary_key_violations
from retentia.plans import registry
from retentia.sources.roles import Roles
from retentia.sources.schemas import CONSTRAINTS, FOREIGN_KEYS, PRIMARY_KEYS
from retentia.sources.warehouse import constraint_report


def rows(df):
    return sorted(map(tuple, df.collect()))


def small(spark):
    parent = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5), ("c", -1)], "id string, n int")
    child = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("y", None, None), ("z", 2, "q"), ("z", 3, "q"), ("w", 4, "c"), (None, 1, "a")],
                                  "k string, seq int, parent string")
    other = spark.createDataFrame([(2, "a"), (9, "b"), (None, None)], "n int, parent string")
    return {"parent": parent, "child": child, "other": other}


KEYS = {"parent": ["id"], "child": ["k", "seq"], "absent": ["x"]}
FKS = [("child", "parent", "parent", "id"), ("other", "parent", "parent", "id"), ("other", "n", "parent", "n"), ("absent", "x", "parent", "id")]


def test_report_equals_single_checks(spark):
    t = small(spark)
    checks = {"parent": column_checks(not_null=["id"], non_negative=["n"], between=[("n", 1, 3)], max_length=[("id", 0)])}
    want = rows(check_constraints(t["parent"], ["id"], ["n"], [("n", 1, 3)], [("id", 0)], "parent"))
    want += [(n, f"primary_key({','.join(KEYS[n])})", primary_key_violations(t[n], KEYS[n]).count()) for n in ("parent", "child")]
    want += [(c, f"foreign_key({k}->{p}.{q})", foreign_key_violations(t[c], k, t[p], q).count()) for c, k, p, q in FKS[:3]]
    assert rows(KeyAudit(t, KEYS, FKS, checks).report()) == sorted(want)


def test_orphans_and_keys(spark):
    t = small(spark)
    audit = KeyAudit(t, KEYS, FKS)
    assert rows(audit.orphans()) == rows(orphan_audit([(f"{c}.{k}", t[c], k, t[p], q) for c, k, p, q in FKS[:3]]))
    got = {r["table_name"]: r for r in audit.keys().collect()}
    assert tuple(got["parent"])[2:] == (6, 4, 1, 1) and tuple(got["child"])[2:] == (7, 6, 2, 1)
    assert got["parent"]["repeated_keys"] == dup_keys(t["parent"].where("id IS NOT NULL"), ["id"]).count()


def test_empty_tables_and_clean_ones(spark):
    t = {n: df.limit(0) for n, df in small(spark).items()}
    assert {v for _, _, v in rows(KeyAudit(t, KEYS, FKS).report())} == {0}
    assert {v for _, v in rows(KeyAudit(t, {}, FKS).orphans())} == {0}


def test_each_table_is_scanned_once(spark):
    """Three shuffles: by key, by domain, and that of the collapsed geolocation."""
    loaded = registry._loaded(Roles(spark, SF001))
    stored = {}
    for name, df in loaded.items():
        path = spark.sparkContext.getCheckpointDir() + f"/keys-{name}"
        df.write.mode("overwrite").parquet(path)
        stored[name] = spark.read.parquet(path)
    report = constraint_report(stored)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == len(stored)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    want = []
    for name, df in stored.items():
        want += rows(check_constraints(df, table=name, **CONSTRAINTS[name])) if name in CONSTRAINTS else []
        want.append((name, f"primary_key({','.join(PRIMARY_KEYS[name])})", primary_key_violations(df, PRIMARY_KEYS[name]).count()))
    want += [(c, f"foreign_key({k}->{p}.{q})", foreign_key_violations(stored[c], k, stored[p], q).count()) for c, k, p, q in FOREIGN_KEYS]
    assert rows(report) == sorted(want) and sum(v for _, _, v in want) > 0


def test_a_hot_key_is_one_row_a_task_before_the_shuffle(spark):
    """A third of all children name one parent: the plan aggregates before it shuffles."""
    child = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("p"))
    audit = KeyAudit({"child": child, "parent": spark.range(2000)}, {"parent": ["id"]}, [("child", "p", "parent", "id")])
    assert {v for _, _, v in rows(audit.report()) if v} == {sum(1 for i in range(2000, 3000) if i % 3)}
    plan = audit.per_key()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("HashAggregate")
