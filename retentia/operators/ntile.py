"""Global ROW_NUMBER and NTILE without a single-task window.

``ntile(k) OVER (ORDER BY x)`` with no PARTITION BY would move every row into
one task. Here the rows are range-partitioned on a *total* order key (the metric
plus the entity key, so even one value shared by most rows is split over many
partitions), sorted inside each partition and tagged with their position. The
tagged rows are written to the checkpoint folder: range bounds come from
sampling, so a recomputation must not be allowed to move rows. The per-partition
counts (one row per partition, a proven size bound) give each partition's
offset, which is broadcast back. The same steps are taken at every size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.session import checkpoint_dir

_PID, _MID = "__pid", "__mid"


def _order_columns(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (lineage cut)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/retentia-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _distributed_row_number(df: DataFrame, order: list[Column], name: str,
                            partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = materialize(df.repartitionByRange(n, *order)
                         .sortWithinPartitions(*order)
                         .withColumn(_PID, F.spark_partition_id())
                         .withColumn(_MID, F.monotonically_increasing_id()), "rn")
    per_part = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__cnt"),
                                         F.min(_MID).alias("__first"))
    # one row per partition: a window over it is tiny
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PID, "__first",
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"),
        F.sum("__cnt").over(Window.partitionBy()).alias("__total"))
    out = (tagged.join(F.broadcast(offsets), _PID)
           .withColumn(name, F.col("__off") + (F.col(_MID) - F.col("__first")) + 1))
    return out.drop(_PID, _MID, "__first", "__off").withColumnRenamed("__total", f"{name}_total")


def global_row_number(df: DataFrame, order: list, name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Add ``name`` = ROW_NUMBER() OVER (ORDER BY *order*) and ``{name}_total`` = row count.

    ``order`` must be a total order (end it with a unique key).
    """
    return _distributed_row_number(df, _order_columns(order), name, partitions)


def ntile_from_rank(rn: Column, total: Column, k: int) -> Column:
    """NTILE(k) bucket of the rn-th of ``total`` ordered rows (SQL semantics).

    The first ``total % k`` buckets hold one row more than the others.
    """
    q = F.floor(total / F.lit(k)).cast("long")
    r = (total % F.lit(k)).cast("long")
    big = r * (q + 1)
    first = F.ceil(rn / (q + 1))
    rest = r + F.ceil((rn - big) / F.when(q == 0, F.lit(1)).otherwise(q))
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def global_ntiles(df: DataFrame, k: int, orders: dict[str, list],
                  partitions: int | None = None) -> DataFrame:
    """Add one NTILE(k) column per entry of ``orders`` ({column: order})."""
    out = df
    for name, order in orders.items():
        out = _distributed_row_number(out, _order_columns(order), "__rn", partitions)
        out = (out.withColumn(name, ntile_from_rank(F.col("__rn"), F.col("__rn_total"), k))
               .drop("__rn", "__rn_total"))
    return out


def global_ntile(df: DataFrame, k: int, order: list, name: str = "ntile",
                 partitions: int | None = None) -> DataFrame:
    """Add ``name`` = NTILE(k) OVER (ORDER BY *order*)."""
    return global_ntiles(df, k, {name: order}, partitions)
