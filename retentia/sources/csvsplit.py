"""CSV files with quoted line breaks, read by many tasks, and where their bad records lie.

A reader that meets a line in the middle of a file does not know whether it lies
inside quotes; so a multi-line CSV file is usually read from its start by one task.
Here each byte range (a scan split) is read on its own, without that knowledge:

1. A line counts the quotes before it in its split, and the records that start up to
   it under both assumptions (the split starts outside, or inside, quotes). These
   lines are written once, so that later steps cannot see other splits.
2. Per split, one row is left: its quotes (odd or even), its record starts under both
   assumptions, its lines. A running sum over a file's splits (a prefix combine) tells
   which assumption holds and how many records and lines come before.
3. Each line then knows its record's number in its file. A line that starts and ends a
   record is that record; only the lines of the other records are shuffled together.

Records are parsed by Spark's own CSV parser, one by one, so malformed ones are named
by file, record number (1 is the first below the header), line number and reason.

Lines that are blank outside quotes are no records. A line break inside quotes comes
back as LF. A quote that is never closed makes the rest of its file one record that has
no end: it is reported, not gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from retentia.operators.ntile import materialize
from retentia.sources.schemas import raw_schema

_LINES = "file string, block long, line long, value string, inside int, quotes int, starts0 long, starts1 long"
_CORRUPT = "_corrupt_record"


def _scan_lines(batches):
    """Counts of each line within its split; a task's splits come one after the other."""
    split, inside, line, starts = None, 0, 0, [0, 0]
    for batch in batches:
        files, blocks, values = batch.column(0), batch.column(1), batch.column(2)
        odd = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_numpy().astype(np.int64)
        blank = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(values)), 0).to_numpy(zero_copy_only=False)
        names = list(zip(files.to_pylist(), blocks.to_pylist()))
        cuts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]] + [len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if names[a] != split:
                split, inside, line, starts = names[a], 0, 0, [0, 0]
            before = (inside + np.cumsum(odd[a:b]) - odd[a:b]) & 1
            counts = [starts[h] + np.cumsum(((before ^ h) == 0) & ~blank[a:b]) for h in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [files.slice(a, b - a), blocks.slice(a, b - a), pa.array(line + np.arange(b - a)), values.slice(a, b - a),
                 pa.array(before.astype(np.int32)), pa.array(odd[a:b].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in counts)],
                names=["file", "block", "line", "value", "inside", "quotes", "starts0", "starts1"])
            inside, line = int(before[-1] + odd[b - 1]) & 1, line + b - a
            starts = [int(c[-1]) for c in counts]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, the physical line (from 1), value, quotes (odd or even), whether the line lies inside quotes, its record (from 0), and the file's last record if that never ends."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = materialize(text.mapInArrow(_scan_lines, _LINES), "csv-lines")
    splits = lines.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("odd"), F.max("starts0").alias("s0"), F.max("starts1").alias("s1"),
        F.count(F.lit(1)).alias("lines"))
    order = Window.partitionBy("file").orderBy("block")  # a file's splits
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    splits = splits.withColumn("begin", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    splits = splits.withColumn("own", F.when(F.col("begin") == 0, F.col("s0")).otherwise(F.col("s1")))
    splits = splits.select(
        "file", "block", "begin", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("records_before"),
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
        F.when(F.sum("odd").over(whole) % 2 == 1, F.sum("own").over(whole)).alias("endless"))
    joined = lines.join(F.broadcast(splits), ["file", "block"])  # one row per split
    starts = F.when(F.col("begin") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    return joined.select(
        "file", "block", (F.col("lines_before") + F.col("line") + 1).alias("line"), "value", "quotes",
        (F.col("inside").bitwiseXOR(F.col("begin")) == 1).alias("inside"),
        (F.col("records_before") + starts - 1).alias("record"), (F.col("endless") - 1).alias("endless"))


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """file, record (from 1 below the header), line where it starts, n_lines, text, and whether it ends (``closed``)."""
    lines = numbered_lines(spark, path).where(F.col("inside") | (F.length(F.trim("value")) > 0))
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
    start, endless = ~F.col("inside"), F.col("record").eqNullSafe(F.col("endless"))
    single = lines.where(start & (F.col("quotes") == 0) & ~endless).select(
        "file", "record", "line", F.lit(1).cast("long").alias("n_lines"), F.col("value").alias("text"), F.lit(True).alias("closed"))
    longer = lines.where((F.col("inside") | (F.col("quotes") == 1)) & ~endless).groupBy("file", "record").agg(
        F.min("line").alias("line"), F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"),
        F.lit(True).alias("closed"))
    # the record that never ends: its first line stands for it
    rest = lines.where(endless).groupBy("file", "record").agg(
        F.min("line").alias("line"), F.count(F.lit(1)).alias("n_lines"), F.min_by("value", "line").alias("text"), F.lit(False).alias("closed"))
    out = single.unionAll(longer).unionAll(rest)
    return out.where(F.col("record") > 0) if header else out.withColumn("record", F.col("record") + 1)


def parsed_records(spark: SparkSession, table: str, path: str, sep: str = ",") -> DataFrame:
    """The raw columns of ``table`` with file, record, line, n_lines, text and ``reason`` (NULL for a good record)."""
    schema = raw_schema(table)
    columns = [f.name for f in schema.fields]
    found = records(spark, path)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    with_corrupt = StructType([*schema.fields, StructField(_CORRUPT, StringType(), True)])
    row = F.from_csv("text", with_corrupt.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", "), options)
    outside = F.regexp_replace("text", '"([^"]|"")*"', "")
    fields = F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit(""))) + 1
    reason = (F.when(~F.col("closed"), "quote never closed")
              .when(F.col("row")[_CORRUPT].isNotNull() | (fields != len(columns)),
                    F.concat(fields.cast("string"), F.lit(f" fields instead of {len(columns)}"))))
    return (found.withColumn("row", F.when(F.col("closed"), row)).withColumn("reason", reason)
            .select("file", "record", "line", "n_lines", "text", "reason", *[F.col("row")[c].alias(c) for c in columns]))


def bad_records(parsed: DataFrame) -> DataFrame:
    """(file, record, line, n_lines, reason, text) of each malformed record of ``parsed_records``."""
    return parsed.where(F.col("reason").isNotNull()).select("file", "record", "line", "n_lines", "reason", "text")


def read_multiline(spark: SparkSession, table: str, path: str, on_bad: str = "fail",
                   sep: str = ",") -> DataFrame | tuple[DataFrame, DataFrame]:
    """The raw columns of ``table``, as ``read_raw(multiline=True)`` gives them, from a file of any size.

    ``on_bad``: ``'fail'`` raises where a malformed record is read, naming its file,
    record and line; ``'drop'`` leaves it out; ``'quarantine'`` returns ``(good, bad)``
    with the place, the reason and the text (``_corrupt_record``) of each bad one.
    """
    if on_bad not in ("fail", "drop", "quarantine"):
        raise ValueError("on_bad must be one of ['drop', 'fail', 'quarantine']")
    parsed = parsed_records(spark, table, path, sep)
    columns = [f.name for f in raw_schema(table).fields]
    is_good = F.col("reason").isNull()
    if on_bad == "fail":
        message = F.concat(F.lit("malformed CSV record "), F.col("record").cast("string"), F.lit(", line "), F.col("line").cast("string"),
                           F.lit(" of "), F.col("file"), F.lit(": "), F.col("reason"))
        return parsed.where(F.when(is_good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*columns)
    if on_bad == "drop":
        return parsed.where(is_good).select(*columns)
    parsed = materialize(parsed, f"raw-{table}")
    bad = bad_records(parsed).withColumnRenamed("text", _CORRUPT)
    return parsed.where(is_good).select(*columns), bad
