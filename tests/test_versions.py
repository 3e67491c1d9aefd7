"""Writes that stop midway, competing writers, and appends by partition."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from retentia.sources.versions import ConcurrentCommit, VersionedFolder, VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def failing(df):
    """The same rows, but the write breaks off after some of them."""
    return df.withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("stopped"))).otherwise(F.col("v")))


SCHEMA = "month string, id string, v int"


@pytest.mark.parametrize("by", [None, ["month"]])
def test_a_write_that_stops_leaves_the_old_table(spark, by):
    table = VersionedTable(spark, tempfile.mkdtemp() + "/t", by)
    with pytest.raises(FileNotFoundError):
        table.read()
    first = [("2018-01", "1", 1), ("2018-01", "2", 2), ("2018-02", "9", 9), (None, "8", 8)]
    assert table.overwrite(spark.createDataFrame(first, SCHEMA)) == 1
    broken = failing(spark.createDataFrame([("2018-01", "3", 3), ("2018-02", "9", -1)], SCHEMA).repartition(2))
    for write in (lambda: table.overwrite(broken), lambda: table.append(broken, ["id"])):
        with pytest.raises(Exception, match="stopped"):
            write()
        assert rows(table.read()) == sorted(first, key=repr) and table.numbers() == [1]


@pytest.mark.parametrize("by", [None, ["month"]])
def test_append_replaces_known_keys_and_is_idempotent(spark, by):
    table = VersionedTable(spark, tempfile.mkdtemp() + "/t", by)
    table.overwrite(spark.createDataFrame([("2018-01", "1", 1), ("2018-01", "2", 2), ("2018-02", "9", 9)], SCHEMA))
    more = spark.createDataFrame([("2018-01", "3", 3), ("2018-03", "9", 90), ("2018-01", "2", 20)], SCHEMA)
    want = [("2018-01", "1", 1), ("2018-01", "2", 20), ("2018-01", "3", 3), ("2018-03", "9", 90)]
    for _ in range(2):
        table.append(more, ["id"])
        assert rows(table.read()) == want  # the partition 2018-02 has lost its only row
    assert rows(table.read(1)) == [("2018-01", "1", 1), ("2018-01", "2", 2), ("2018-02", "9", 9)]
    assert len(table.vacuum()) >= 1 and rows(table.read()) == want and len(table.numbers()) == 1


def test_append_rewrites_only_touched_partitions(spark):
    table = VersionedTable(spark, tempfile.mkdtemp() + "/t", ["month"])
    table.overwrite(spark.createDataFrame([(f"2018-{m:02d}", str(m), m) for m in range(1, 10)], SCHEMA))
    table.append(spark.createDataFrame([("2018-03", "x", 1)], SCHEMA), ["id"])
    folders = table.record(2)["folders"]
    assert [len(f["partitions"]) for f in folders] == [8, 1] and ["2018-03"] not in folders[0]["partitions"]
    assert table.read().count() == 10


def test_of_two_writers_one_commits(spark):
    root = tempfile.mkdtemp() + "/t"
    table = VersionedTable(spark, root)
    table.overwrite(spark.createDataFrame([("a", "1", 1)], SCHEMA))
    number, _ = table.next_folder()
    table.overwrite(spark.createDataFrame([("b", "2", 2)], SCHEMA))
    with pytest.raises(ConcurrentCommit):
        table.commit(number, {"folders": []})
    assert rows(table.read()) == [("b", "2", 2)]


def test_folder_is_published_whole(spark):
    folder = VersionedFolder(spark, tempfile.mkdtemp() + "/layer")
    assert folder.current() is None
    build = lambda n: lambda path: [spark.range(n).write.parquet(f"{path}/{t}") for t in ("a", "b")]
    folder.publish(build(3))
    seen = folder.current()

    def stops(path):
        spark.range(9).write.parquet(f"{path}/a")
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        folder.publish(stops)
    assert folder.current() == seen and spark.read.parquet(f"{seen}/a").count() == 3
    folder.publish(build(5))
    assert spark.read.parquet(f"{folder.current()}/b").count() == 5


def test_empty_tables(spark):
    table = VersionedTable(spark, tempfile.mkdtemp() + "/t", ["month"])
    table.overwrite(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0
    table.append(spark.createDataFrame([("m", "1", 1)], SCHEMA), ["id"])
    table.append(spark.createDataFrame([], SCHEMA), ["id"])
    assert rows(table.read()) == [("m", "1", 1)]
