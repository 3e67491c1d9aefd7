"""Multi-line CSV read in many splits, against one-task reading and a plain scan."""

from __future__ import annotations

import csv
import os
import random
import tempfile

import pytest

from retentia.sources.csvsplit import bad_records, parsed_records, read_multiline, records
from retentia.sources.ingest import read_raw
from retentia.sources.schemas import RAW_COLUMNS

COLUMNS = RAW_COLUMNS["order_reviews"]


def write(content: bytes) -> str:
    path = os.path.join(tempfile.mkdtemp(), "reviews.csv")
    with open(path, "wb") as f:
        f.write(content)
    return path


@pytest.fixture(params=["1m", "400", "90"])
def split(request, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def reviews(n=120, end="\n"):
    rng, rows = random.Random(n), []
    for k in range(n):
        message = rng.choice(["plain", "", "two\nlines", 'a "quoted" word', "one, two,\n\n\nthree", '"\n"', "x" * 300, "é\nü"])
        rows.append([f"r{k}", f"o{k}", str(k % 5 + 1), "title, with comma", message, "2018-01-01", "2018-01-02"])
    lines = [",".join(COLUMNS)]
    for row in rows:
        lines.append(",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v for v in row))
    return rows, end.join(lines) + end


def test_equal_to_one_task_whatever_the_cuts(spark, split):
    rows, text = reviews()
    path = write(text.encode())
    parsed = read_multiline(spark, "order_reviews", path)
    got = sorted(map(tuple, parsed.collect()))
    assert got == sorted(map(tuple, read_raw(spark, "order_reviews", path, multiline=True).collect()))
    assert [r[:4] for r in got] == [tuple(r[:4]) for r in sorted(rows)]
    assert [r[4] or "" for r in got] == [r[4] for r in sorted(rows)]
    if split == "90":
        assert spark.read.text(path).rdd.getNumPartitions() > 20


def test_record_and_line_numbers(spark, split):
    _, text = reviews(60)
    path = write(text.encode())
    got = [(r["record"], r["line"], r["n_lines"]) for r in records(spark, path).orderBy("record").collect()]
    with open(path, newline="") as f:
        reader, want, before = csv.reader(f), [], 0
        for k, _ in enumerate(reader):
            if k:
                want.append((k, before + 1))
            before = reader.line_num
    assert [(r, line) for r, line, _ in got] == want


def test_bom_crlf_blank_lines_and_several_files(spark, split):
    rows, text = reviews(30, "\r\n")
    folder = tempfile.mkdtemp()
    for k in range(3):
        with open(f"{folder}/part{k}.csv", "wb") as f:
            f.write(b"\xef\xbb\xbf" + text.replace("\nr1", "\n\r\nr1").encode())
    got = read_multiline(spark, "order_reviews", folder).collect()
    assert len(got) == 90 and {r["review_id"] for r in got} == {r[0] for r in rows}
    assert {(r["review_id"], r["review_comment_message"] or "") for r in got} == {(r[0], r[4]) for r in rows}


def test_places_of_bad_records(spark, split):
    head = ",".join(COLUMNS)
    good = 'r{0},o{0},5,t,"several\nlines",d,d'
    lines = [head, *[good.format(k) for k in range(20)], "only,three,fields", good.format(50), 'r,o,5,t,"m\nm",d,d,extra', good.format(51)]
    path = write("\n".join(lines).encode())
    bad = [(r["record"], r["line"], r["n_lines"], r["reason"]) for r in bad_records(parsed_records(spark, "order_reviews", path)).orderBy("record").collect()]
    assert bad == [(21, 42, 1, "3 fields instead of 7"), (23, 45, 2, "8 fields instead of 7")]
    kept, quarantined = read_multiline(spark, "order_reviews", path, on_bad="quarantine")
    assert kept.count() == 22 and [r["_corrupt_record"] for r in quarantined.orderBy("record").collect()] == [lines[21], lines[23]]
    assert read_multiline(spark, "order_reviews", path, on_bad="drop").count() == 22
    with pytest.raises(Exception, match="record 2[13], line 4[25] .*fields instead of 7"):
        read_multiline(spark, "order_reviews", path).collect()
    with pytest.raises(ValueError):
        read_multiline(spark, "order_reviews", path, on_bad="ignore")


def test_quote_that_is_never_closed(spark, split):
    head, good = ",".join(COLUMNS), 'r{0},o{0},5,t,m,d,d'
    path = write("\n".join([head, good.format(1), 'r2,o2,5,t,"open', *[good.format(k) for k in range(3, 40)]]).encode())
    kept, bad = read_multiline(spark, "order_reviews", path, on_bad="quarantine")
    assert [r["review_id"] for r in kept.collect()] == ["r1"]
    assert [(r["record"], r["line"], r["n_lines"], r["reason"], r["_corrupt_record"]) for r in bad.collect()] == \
        [(2, 3, 38, "quote never closed", 'r2,o2,5,t,"open')]


def test_empty_file(spark):
    assert read_multiline(spark, "order_reviews", write(b"")).count() == 0
    assert read_multiline(spark, "order_reviews", write((",".join(COLUMNS) + "\n").encode())).count() == 0
