"""End-to-end batch load of CSV extracts, and the streaming incremental load."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from retentia.sources.schemas import RAW_COLUMNS
from retentia.sources.warehouse import build_cleaned_layer, ensure_namespace
from retentia.streaming import stream_cleaned

ROWS = {
    "customers": ["c1,u1,01001,sao paulo,sp", "c2,u1,01001,sao paulo,sp", "c3,u2,20000,rio de janeiro,RJX"],
    "geolocation": ["01001,-23.5,-46.6,sao paulo,sp", "01001,-23.7,-46.8,sao paulo,sp"],
    "order_items": ["o1,1,p1,s1,2017-01-02 10:00:00,10.00,2.50", "o2,1,p9,s1,2017-02-02 10:00:00,20.00,1.00"],
    "order_payments": ["o1,1,credit_card,2,12.50", "o2,1,voucher,1,21.00"],
    "order_reviews": ['r1,o1,5,,"great,\nthanks",2017-01-10 00:00:00,2017-01-11 00:00:00',
                      "r1,o2,,,,2017-02-10 00:00:00,"],
    "orders": ["o1,c1,delivered,2017-01-01 10:00:00,,,2017-01-05 10:00:00,2017-01-20 00:00:00",
               "o2,c2,DELIVERED,2017-02-01 10:00:00,,,,2017-02-20 00:00:00",
               "o3,c9,canceled,2017-03-01 10:00:00,,,,"],
    "products": ["p1,beleza_saude,10,100,1,500,10,10,10"],
    "sellers": ["s1,01001,sao paulo,SP"],
    "product_category_name_translation": ["beleza_saude,health_beauty"],
}


def _landing(tables=ROWS) -> str:
    d = tempfile.mkdtemp(prefix="retentia-raw-")
    for t, rows in tables.items():
        with open(os.path.join(d, f"{t}.csv"), "w", newline="") as fh:
            fh.write(",".join(RAW_COLUMNS[t]) + "\n" + "\n".join(rows) + "\n")
    return d


def test_build_cleaned_layer_reports_seeded_violations(spark):
    raw = _landing()
    out = tempfile.mkdtemp(prefix="retentia-clean-")
    ensure_namespace(spark, "cleaned")
    report = {(r.table_name, r.constraint): r.violations
              for r in build_cleaned_layer(spark, raw, out).collect()}
    assert report[("customers", "max_length(state,2)")] == 1          # 'RJX'
    assert report[("orders", "foreign_key(customer_id->customers.customer_id)")] == 1  # c9
    assert report[("order_items", "foreign_key(product_id->products.product_id)")] == 1  # p9
    assert report[("order_reviews", "primary_key(order_id,review_id)")] == 0
    assert report[("geolocation", "primary_key(zip_code_prefix)")] == 0
    counts = {r.table_name: (r.raw_rows, r.cleaned_rows, r.counts_match)
              for r in spark.read.parquet(f"{out}/_row_counts").collect()}
    assert counts["orders"] == (3, 3, True) and counts["order_reviews"] == (2, 2, True)
    assert counts["geolocation"] == (2, 1, False)  # collapsed to one row per zip prefix
    orders = spark.read.parquet(f"{out}/orders")
    assert orders.where(F.col("order_status") == "delivered").count() == 2
    reviews = spark.read.parquet(f"{out}/order_reviews").orderBy("order_id").collect()
    assert reviews[0].review_comment_message == "great,\nthanks" and reviews[1].review_score is None


def test_loaded_layer_keeps_raw_rows_and_stores_the_person_key(spark):
    from retentia.plans.registry import run_on_roles
    from retentia.sources.roles import CleanedRoles
    raw = _landing({**ROWS, "geolocation": ["01001,-23.5,-46.6,sao paulo,sp"] * 3 + ["01001,-23.7,-46.8,sao paulo,sp"]})
    out = tempfile.mkdtemp(prefix="retentia-rawlayer-")
    build_cleaned_layer(spark, raw, out)
    roles = CleanedRoles(spark, out)
    assert tuple(run_on_roles("duplicate_rows", roles).first()) == (4, 2)
    assert tuple(run_on_roles("duplicate_rows_raw", roles).first()) == (4, 2)
    assert {r.order_id: r.customer_unique_id for r in roles.orders.collect()} == {"o1": "u1", "o2": "u1", "o3": None}
    plan = run_on_roles("second_purchase_stats", roles)._jdf.queryExecution().optimizedPlan().toString()
    assert "customer_unique_id" in plan and "customer_city" not in plan and plan.count("Join") == 0
    counts = {r.table_name: r.counts_match for r in run_on_roles("raw_cleaned_counts", roles).collect()}
    assert counts.pop("geolocation") is False and all(counts.values())


def test_repeated_customer_id_does_not_double_orders(spark):
    raw = _landing({**ROWS, "customers": ROWS["customers"] + ["c1,u0,01001,sao paulo,sp"]})
    out = tempfile.mkdtemp(prefix="retentia-dupcust-")
    report = {(r.table_name, r.constraint): r.violations for r in build_cleaned_layer(spark, raw, out).collect()}
    assert report[("customers", "primary_key(customer_id)")] == 1
    orders = {r.order_id: r.customer_unique_id for r in spark.read.parquet(f"{out}/orders").collect()}
    assert orders == {"o1": "u0", "o2": "u1", "o3": None}


def test_buckets_follow_bytes(spark):
    from retentia.sources import roles
    df = spark.range(1000)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert roles.bucket_count(spark, df) == least
    kept, roles.BUCKET_BYTES = roles.BUCKET_BYTES, 100
    try:
        assert roles.bucket_count(spark, df) == 80  # 8000 bytes
    finally:
        roles.BUCKET_BYTES = kept


def test_streaming_load_is_incremental_and_exactly_once(spark):
    landing = tempfile.mkdtemp(prefix="retentia-land-")
    out = tempfile.mkdtemp(prefix="retentia-sink-")
    ckpt = tempfile.mkdtemp(prefix="retentia-stream-ckpt-")

    def drop(name, rows):
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(",".join(RAW_COLUMNS["order_payments"]) + "\n" + "\n".join(rows) + "\n")

    drop("a.csv", ["o1,1,credit_card,2,12.50", "o2,1,voucher,1,21.00"])
    stream_cleaned(spark, "order_payments", landing, out, ckpt).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    drop("b.csv", ["o3,1,boleto,1,5.00"])
    stream_cleaned(spark, "order_payments", landing, out, ckpt).awaitTermination(120)
    stream_cleaned(spark, "order_payments", landing, out, ckpt).awaitTermination(120)  # nothing new
    got = spark.read.parquet(out)
    assert got.count() == 3
    assert str(got.agg(F.sum("payment_value")).first()[0]) == "38.50"


def test_cli_load_then_run_queries_on_cleaned_layer(spark, capsys):
    from retentia.__main__ import main
    raw = _landing()
    out = tempfile.mkdtemp(prefix="retentia-cli-")
    assert main(["load", raw, f"{out}/cleaned"]) == 0
    assert main(["list"]) == 0
    assert "executive_summary" in capsys.readouterr().out
    assert main(["run", "executive_summary", "--cleaned-dir", f"{out}/cleaned",
                 "--out", f"{out}/res"]) == 0
    res = spark.read.option("header", True).csv(f"{out}/res").first()
    # delivered orders with a payment: o1 and o2, both of person u1
    assert (res.total_orders, res.total_unique_customers, res.total_revenue) == ("2", "1", "33.50")
    for key in ("monthly_trends", "rfm_hybrid", "churn_status", "orphan_audit", "category_gmv"):
        assert main(["run", key, "--cleaned-dir", f"{out}/cleaned", "--out", f"{out}/{key}"]) == 0
    orphans = {r.fk: r.orphans for r in spark.read.option("header", True).csv(f"{out}/orphan_audit").collect()}
    assert orphans["orders.customer_id"] == "1" and orphans["order_items.product_id"] == "1"


def test_bucketed_cleaned_layer_in_catalog(spark):
    from retentia.plans import registry
    from retentia.sources.roles import CleanedRoles
    raw = _landing()
    out = tempfile.mkdtemp(prefix="retentia-bucketed-")
    db = "cleaned_bucket_test"
    build_cleaned_layer(spark, raw, out, database=db, order_buckets=4)
    assert spark.catalog.tableExists(f"{db}.orders")
    roles = CleanedRoles(spark, out, database=db)
    plain = CleanedRoles(spark, out)
    for key in ("executive_summary", "payment_reconciliation", "reviews_one_time_vs_repeat"):
        a = sorted(map(tuple, registry.run_on_roles(key, roles).collect()), key=str)
        b = sorted(map(tuple, registry.run_on_roles(key, plain).collect()), key=str)
        assert a == b
    # per-order aggregate over a bucketed table: no shuffle below it
    from retentia.operators.common import payment_totals
    plan = payment_totals(roles.order_payments)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
