"""Raw CSV extracts -> typed cleaned tables -> constraint report.

``build_cleaned_layer`` is the batch load of the nine extracts: read each CSV
into the all-text raw schema, clean it into its typed table, write it (drop
and recreate), then check every declared constraint (NOT NULL, CHECK, CHAR(2),
primary keys, foreign keys) in one report. Spark does not enforce constraints
on Parquet tables, so the report is what the database's constraint validation
was; ``strict=True`` fails the load on any violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.clean import CLEANERS
from retentia.operators.keys import KeyAudit, column_checks
from retentia.operators.quality import row_count_check
from retentia.sources.csvsplit import read_multiline
from retentia.sources.ingest import read_raw, write_table
from retentia.sources.schemas import CONSTRAINTS, FOREIGN_KEYS, PRIMARY_KEYS
from retentia.sources.versions import VersionedFolder

# Default file of each extract inside ``raw_dir``: ``<table>.csv`` (pass ``files`` to map others).
DEFAULT_FILES = {t: f"{t}.csv" for t in CLEANERS}
MULTILINE = {"order_reviews"}


def ensure_namespace(spark: SparkSession, name: str) -> None:
    """CREATE DATABASE IF NOT EXISTS (the raw / cleaned namespaces)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, constraint, violations) for every declared constraint of the given tables, in one shuffle."""
    checks = {t: column_checks(**spec) for t, spec in CONSTRAINTS.items()}
    return KeyAudit(tables, PRIMARY_KEYS, FOREIGN_KEYS, checks).report()


# Tables keyed by order_id: bucketed together so their joins and per-order aggregates are co-located.
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")


def save_cleaned(df: DataFrame, table: str, out_dir: str, database: str | None = None,
                 order_buckets: int | None = None) -> DataFrame:
    """Write one cleaned table and return it read back.

    With ``database`` it is also registered as ``database.table`` (files stay
    under ``out_dir``); with ``order_buckets`` the order-keyed tables are
    bucketed and sorted by ``order_id`` (after a repartition on the same key, so
    each bucket is one file), the layout that replaces the foreign-key indexes.
    """
    path = f"{out_dir}/{table}"
    if database is None:
        write_table(df, path)
        return df.sparkSession.read.parquet(path)
    writer = df
    if order_buckets and table in ORDER_KEYED:
        writer = df.repartition(order_buckets, "order_id")
    w = writer.write.mode("overwrite").option("path", path)
    if order_buckets and table in ORDER_KEYED:
        w = w.bucketBy(order_buckets, "order_id").sortBy("order_id")
    w.saveAsTable(f"`{database}`.`{table}`")
    return df.sparkSession.table(f"`{database}`.`{table}`")


def with_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with ``customer_unique_id``, resolved once so that person-level queries need no join.

    A customer_id that occurs twice breaks the primary key and is reported as such; its
    smallest person is taken, so that no order is doubled.
    """
    person = customers.groupBy("customer_id").agg(F.min("customer_unique_id").alias("customer_unique_id"))
    return orders.join(person, "customer_id", "left").select(*orders.columns, "customer_unique_id")


def publish_cleaned_layer(spark: SparkSession, raw_dir: str, root: str, **options) -> DataFrame:
    """``build_cleaned_layer`` into a new version of ``root``, which readers see when all of it is written.

    A load that stops midway leaves the version before it in place; ``CleanedRoles`` reads the newest one.
    """
    return VersionedFolder(spark, root).publish(lambda folder: build_cleaned_layer(spark, raw_dir, folder, **options))


def build_cleaned_layer(spark: SparkSession, raw_dir: str, out_dir: str,
                        files: dict[str, str] | None = None, on_bad: str = "fail",
                        strict: bool = False, database: str | None = None,
                        order_buckets: int | None = None) -> DataFrame:
    """Load every extract found in ``raw_dir``, write cleaned tables under ``out_dir``.

    ``database`` also registers them in the catalog (``CREATE DATABASE IF NOT
    EXISTS``), and ``order_buckets`` buckets the order-keyed tables by order_id.
    The parsed text stays under ``out_dir/_raw/<table>`` (the raw layer).
    Returns the constraint report (read back from ``out_dir/_constraints``);
    the raw vs cleaned row counts are written to ``out_dir/_row_counts``. With
    ``on_bad="quarantine"`` malformed records go to ``out_dir/_bad/<table>`` and
    count as raw rows. ``strict`` raises on violations and on lost rows.
    """
    files = files or DEFAULT_FILES
    if database:
        ensure_namespace(spark, database)
    cleaned: dict[str, DataFrame] = {}
    raws: dict[str, DataFrame] = {}
    # customers first: the orders store their person key
    for table, fname in sorted(files.items(), key=lambda item: item[0] == "orders"):
        path = f"{raw_dir.rstrip('/')}/{fname}"
        read = read_multiline if table in MULTILINE else read_raw  # the former reads one file in many tasks
        raw = read(spark, table, path, on_bad=on_bad)
        bad = None
        if on_bad == "quarantine":
            raw, bad = raw
            write_table(bad, f"{out_dir}/_bad/{table}")
        # the text is parsed once; cleaning, counts and duplicate checks read the raw layer
        write_table(raw, f"{out_dir}/_raw/{table}")
        raw = spark.read.schema(raw.schema).parquet(f"{out_dir}/_raw/{table}")
        raws[table] = raw
        if bad is not None:
            # malformed records count as raw rows, so that the gap shows
            one = F.lit(1).alias("row")
            raws[table] = raw.select(one).unionAll(spark.read.schema(bad.schema).parquet(f"{out_dir}/_bad/{table}").select(one))
        frame = CLEANERS[table](raw)
        if table == "orders" and "customers" in cleaned:
            frame = with_person(frame, cleaned["customers"])
        cleaned[table] = save_cleaned(frame, table, out_dir, database, order_buckets)
    counts = row_count_check({t: (raws[t], cleaned[t]) for t in cleaned})
    write_table(counts.coalesce(1), f"{out_dir}/_row_counts")
    report = constraint_report(cleaned)
    write_table(report.coalesce(1), f"{out_dir}/_constraints")
    report = spark.read.parquet(f"{out_dir}/_constraints")
    if strict:
        bad = report.where(F.col("violations") > 0).collect()
        if bad:
            raise ValueError(f"constraint violations: {[tuple(r) for r in bad]}")
        # geolocation is collapsed; all other tables are cleaned row by row
        gaps = spark.read.parquet(f"{out_dir}/_row_counts").where("NOT counts_match AND table_name <> 'geolocation'").collect()
        if gaps:
            raise ValueError(f"rows lost between raw and cleaned: {[tuple(r) for r in gaps]}")
    return report
