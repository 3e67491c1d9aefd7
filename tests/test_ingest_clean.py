"""CSV ingest into the raw layer, typed cleaning, sinks."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from retentia.operators import clean as cl
from retentia.sources.ingest import append, read_raw, write_result_csv
from retentia.sources.schemas import RAW_COLUMNS


def _write(content: bytes, name: str = "f.csv") -> str:
    d = tempfile.mkdtemp(prefix="retentia-csv-")
    path = os.path.join(d, name)
    with open(path, "wb") as fh:
        fh.write(content)
    return path


MESSY_REVIEWS = (
    b"review_id,order_id,review_score,review_comment_title,review_comment_message,"
    b"review_creation_date,review_answer_timestamp\r\n"
    b'r1,o1,5,,"line one\r\nline two",2018-01-18 00:00:00,2018-01-18 21:46:59\r\n'
    b'r2,o2,,"","said ""great"" twice",2018-03-10 00:00:00,\r\n'
    b"r3,o3,4,t,m,2018-02-17 00:00:00,2018-02-18 13:02:51,EXTRA\r\n"
)


def test_multiline_quoted_fields_and_blanks(spark):
    path = _write(MESSY_REVIEWS)
    good, bad = read_raw(spark, "order_reviews", path, multiline=True, on_bad="quarantine")
    rows = {r.review_id: r for r in good.collect()}
    assert set(rows) == {"r1", "r2"}
    # the multi-line reader normalises a CRLF inside quotes to LF
    assert rows["r1"].review_comment_message == "line one\nline two"
    assert rows["r2"].review_comment_message == 'said "great" twice'
    assert rows["r2"].review_score is None and rows["r2"].review_comment_title is None
    assert bad.count() == 1
    cleaned = cl.clean_order_reviews(good).where(F.col("review_id") == "r1").first()
    assert cleaned.review_score == 5 and str(cleaned.review_answer_timestamp) == "2018-01-18 21:46:59"


def test_bad_line_policies(spark):
    path = _write(MESSY_REVIEWS)
    assert read_raw(spark, "order_reviews", path, multiline=True, on_bad="drop").count() == 2
    with pytest.raises(Exception):
        read_raw(spark, "order_reviews", path, multiline=True, on_bad="fail").collect()


def test_bom_crlf_translation_file(spark):
    content = (b"\xef\xbb\xbfproduct_category_name,product_category_name_english\r\n"
               b"beleza_saude,health_beauty\r\n informatica , computers ")
    raw = read_raw(spark, "product_category_name_translation", _write(content))
    got = sorted(map(tuple, cl.clean_category_translation(raw).collect()))
    assert got == [("beleza_saude", "health_beauty"), ("informatica", "computers")]
    assert raw.columns == RAW_COLUMNS["product_category_name_translation"]


def test_clean_customers_and_orders(spark):
    raw_c = spark.createDataFrame([(" c1 ", "u1", "01001", " sao paulo ", "sp")],
                                  ",".join(f"{c} string" for c in RAW_COLUMNS["customers"]))
    c = cl.clean_customers(raw_c).first()
    assert (c.customer_id, c.city, c.state) == ("c1", "Sao Paulo", "SP")
    raw_o = spark.createDataFrame(
        [("o1", "c1", " Delivered ", "2017-10-02 10:56:33", "", "", "", "2017-10-18 00:00:00")],
        ",".join(f"{c} string" for c in RAW_COLUMNS["orders"]))
    o = cl.clean_orders(raw_o).first()
    assert o.order_status == "delivered" and o.order_approved_at is None
    assert str(o.order_purchase_timestamp) == "2017-10-02 10:56:33"


def test_clean_casts_fail_fast_on_bad_numbers(spark):
    raw = spark.createDataFrame([("o1", "1", "p", "s", "2017-09-19 09:45:35", "12.5x", "1.0")],
                                ",".join(f"{c} string" for c in RAW_COLUMNS["order_items"]))
    with pytest.raises(Exception):
        cl.clean_order_items(raw).collect()


def test_geolocation_collapse(spark):
    raw = spark.createDataFrame(
        [(" 01037", "-23.5", "-46.6", "sao paulo", "sp"), ("01037", "-23.7", "-46.8", "são paulo", "SP"),
         ("01046", "-23.1", "-46.1", "embu-guacu", "sp")],
        ",".join(f"{c} string" for c in RAW_COLUMNS["geolocation"]))
    got = {r.zip_code_prefix: r for r in cl.clean_geolocation(raw).collect()}
    assert set(got) == {"01037", "01046"}
    assert abs(got["01037"].lat - (-23.6)) < 1e-9 and got["01046"].city == "Embu-Guacu"
    assert got["01037"].city == "São Paulo"  # MAX of the initcapped names


def test_result_csv_and_idempotent_append(spark):
    d = tempfile.mkdtemp(prefix="retentia-out-")
    df = spark.createDataFrame([("2016-09-01", 1, None)], "m string, n int, v double")
    write_result_csv(df, f"{d}/res")
    text = "".join(open(os.path.join(f"{d}/res", f)).read()
                   for f in os.listdir(f"{d}/res") if f.endswith(".csv"))
    assert text.splitlines()[0] == '"m","n","v"' and "NULL" in text
    batch = spark.createDataFrame([("2017-01", "o1"), ("2017-02", "o2")], "month string, order_id string")
    append(batch, f"{d}/t", ["month"], ["order_id"])
    append(batch.where("month = '2017-02'"), f"{d}/t", ["month"], ["order_id"])
    assert spark.read.parquet(f"{d}/t").count() == 2


def test_append_keeps_other_rows_of_its_partitions(spark):
    d = tempfile.mkdtemp(prefix="retentia-append-")
    schema = "month string, order_id string, v int"
    append(spark.createDataFrame([("2018-01", "1", 1), ("2018-01", "2", 2), ("2018-02", "9", 9)], schema), f"{d}/t", ["month"], ["order_id"])
    append(spark.createDataFrame([("2018-01", "3", 3), ("2018-01", "2", 20)], schema), f"{d}/t", ["month"], ["order_id"])
    got = {(r["month"], r["order_id"], r["v"]) for r in spark.read.schema(schema).parquet(f"{d}/t").collect()}
    assert got == {("2018-01", "1", 1), ("2018-01", "2", 20), ("2018-01", "3", 3), ("2018-02", "9", 9)}


def test_quarantined_records_are_kept_and_fail_a_strict_load(spark):
    from retentia.sources.warehouse import build_cleaned_layer
    d = tempfile.mkdtemp(prefix="retentia-bad-")
    with open(f"{d}/payments.csv", "w", encoding="utf-8") as f:
        f.write("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                "a,1,voucher,1,10.00\nb,1,voucher\nc,1,voucher,1,5.00\nd,1,voucher,1,7.00\n")
    files = {"order_payments": "payments.csv"}
    build_cleaned_layer(spark, d, f"{d}/out", files, on_bad="quarantine")
    assert [r[0] for r in spark.read.parquet(f"{d}/out/_bad/order_payments").collect()] == ["b,1,voucher"]
    counts = spark.read.parquet(f"{d}/out/_row_counts").first()
    assert (counts["raw_rows"], counts["cleaned_rows"]) == (4, 3)
    with pytest.raises(ValueError, match="rows lost"):
        build_cleaned_layer(spark, d, f"{d}/out2", files, on_bad="quarantine", strict=True)


def test_partitioned_write_prunes_on_read(spark):
    from retentia.sources.ingest import write_table
    d = tempfile.mkdtemp(prefix="retentia-part-")
    df = spark.createDataFrame([("2017-01", "o1"), ("2017-02", "o2"), ("2017-02", "o3")],
                               "month string, order_id string")
    write_table(df, f"{d}/t", partition_by=["month"])
    assert {"month=2017-01", "month=2017-02"} <= set(os.listdir(f"{d}/t"))
    q = spark.read.parquet(f"{d}/t").where(F.col("month") == "2017-02")
    assert q.count() == 2
    assert "PartitionFilters: [isnotnull(month" in q._jdf.queryExecution().executedPlan().toString()
