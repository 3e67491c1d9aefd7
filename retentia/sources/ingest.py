"""CSV -> raw tables, and the table sinks.

``read_raw`` is the distributed replacement of a server-side bulk CSV load
and of a single-process pandas loader: header row skipped, columns mapped by
position onto the all-text raw schema, UTF-8 (a BOM is tolerated), CRLF or LF
line ends, optional multi-line quoted fields, and a policy for malformed
lines. Sinks write Parquet; an append that must stay idempotent overwrites
only the partitions it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.ntile import materialize
from retentia.sources.schemas import raw_schema

CORRUPT = "_corrupt_record"
_MODES = {"quarantine": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}


def read_raw(spark: SparkSession, table: str, path: str, multiline: bool = False,
             on_bad: str = "fail", sep: str = ",") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read a CSV extract into the all-string raw schema of ``table``.

    ``on_bad``: ``'fail'`` raises on a malformed line, ``'drop'`` skips it,
    ``'quarantine'`` returns ``(good, bad)`` where ``bad`` holds the original
    text of each malformed line in ``_corrupt_record``. ``multiline=True``
    allows quoted fields spanning lines; such a file is read by one task
    (``csvsplit.read_multiline`` reads it in many), and a CRLF inside quotes comes
    back as LF. An empty field is NULL, quoted or not.
    """
    if on_bad not in _MODES:
        raise ValueError(f"on_bad must be one of {sorted(_MODES)}")
    quarantine = on_bad == "quarantine"
    reader = (spark.read
              .schema(raw_schema(table, CORRUPT if quarantine else None))
              .option("header", True)
              .option("sep", sep)
              .option("encoding", "UTF-8")
              .option("quote", '"')
              .option("escape", '"')
              .option("multiLine", multiline)
              .option("enforceSchema", True)
              .option("mode", _MODES[on_bad]))
    if quarantine:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.csv(path)
    if not quarantine:
        return df
    # the corrupt column may only be filtered on after the scan is materialised
    df = materialize(df, f"raw-{table}")
    bad = df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, bad


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table as Parquet (overwrite = drop-and-recreate / truncate-and-load)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str], keys: list[str]) -> None:
    """Idempotent append: rows whose key is new are added, rows with a known key replace it.

    Existing rows with other keys stay. Only the partitions that hold new or
    replaced rows are rewritten, from a copy in the checkpoint folder, so a
    failure while writing loses nothing that was read. Re-running a load does
    not duplicate rows.
    """
    spark = df.sparkSession
    new = materialize(df.dropDuplicates(keys), "append")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path)
        old = old.select(*[F.col(f.name).cast(f.dataType) for f in new.schema.fields])
        replaced = old.join(new.select(*keys), keys, "left_semi")
        touched = new.select(*partition_by).unionAll(replaced.select(*partition_by)).distinct()
        same = [F.col(f"old.{c}").eqNullSafe(F.col(f"touched.{c}")) for c in partition_by]
        kept = old.alias("old").join(touched.alias("touched"), same, "left_semi").join(new.select(*keys), keys, "left_anti")
        emptied = touched.join(kept.unionByName(new), partition_by, "left_anti")
        if not emptied.isEmpty():
            raise ValueError("a replaced row would leave its partition empty; partition by columns that its key determines")
        new = materialize(kept.select(*new.columns).unionAll(new), "append")
    (new.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by)
     .parquet(path))


def write_result_csv(df: DataFrame, path: str) -> None:
    """Export a result as CSV with a header, quoted values and NULL printed as NULL."""
    (df.write.mode("overwrite")
     .option("header", True)
     .option("quoteAll", True)
     .option("nullValue", "NULL")
     .csv(path))
