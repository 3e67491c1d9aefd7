"""Window results over unbounded orderings without a task that holds them all.

``running_total`` and ``global_rank`` answer SUM(x) OVER (ORDER BY ...) and
RANK() OVER (ORDER BY ...) without PARTITION BY; ``ordered_pages`` answers
ARRAY_AGG(v ORDER BY ...) for groups of any size.

The first two range-partition the rows by a total order, so that equal values are
split too, and write them with what each partition can know on its own: running sums,
and the row of a tie's first member. One row per partition then carries sums, and ties
that run across borders, from partition to partition.

``ordered_pages`` needs no global order: a group's rows are counted per ``grain`` of
time, the grains' counts are summed up in order, and only the rows of one grain of
one group are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.ntile import materialize

_PID, _POS = "__pid", "__pos"


def _sorted_parts(df: DataFrame, order: list[Column], partitions: int | None, tag: str, **more: Column) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumns({_PID: F.spark_partition_id(), _POS: F.monotonically_increasing_id(), **more}), tag)


def running_total(df: DataFrame, order: list[Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = SUM(value) OVER (ORDER BY *order* ROWS UNBOUNDED PRECEDING) and ``{name}_total`` = SUM(value) OVER ().

    ``order`` must be a total order (end it with a unique key).
    """
    parts = _sorted_parts(df, order, partitions, "running")
    sums = parts.groupBy(_PID).agg(F.sum(value).alias("__sum"))
    by = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    base = sums.select(_PID, F.sum("__sum").over(by).alias("__before"), F.sum("__sum").over(Window.partitionBy()).alias("__all"))
    within = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    kind = parts.select(F.sum(value)).schema[0].dataType
    zero = F.lit(0).cast(kind)
    return (parts.withColumn("__in", F.sum(value).over(within)).join(F.broadcast(base), _PID)
            .withColumn(name, (F.coalesce("__in", zero) + F.coalesce("__before", zero)).cast(kind))
            .withColumn(f"{name}_total", F.coalesce("__all", zero))
            .drop(_PID, _POS, "__in", "__before", "__all"))


def global_rank(df: DataFrame, metric: str, unique: list[str], name: str = "rank", descending: bool = True,
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = RANK() OVER (ORDER BY metric), NULLs last; ``unique`` columns tell rows of one metric apart.

    A tie that runs over the border of two or more partitions has one rank: the first row of its first partition.
    """
    first = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    parts = _sorted_parts(df, [first, *[F.col(u) for u in unique]], partitions, "rank")
    ties = Window.partitionBy(_PID, metric)
    parts = parts.withColumn("__first", F.min(_POS).over(ties))
    per = parts.groupBy(_PID).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_POS).alias("__start"), F.min_by(F.struct(metric), _POS).alias("__head"),
        F.max_by(F.struct(metric, F.col("__first")), _POS).alias("__tail"))
    by = Window.orderBy(_PID)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # where the last tie of each partition begins, if it does not go on from the one before
    last = F.lag("__tail").over(by)
    goes_on = last.isNotNull() & F.col("__head")[metric].eqNullSafe(last[metric])
    whole = goes_on & F.col("__head")[metric].eqNullSafe(F.col("__tail")[metric])  # the partition is nothing but that tie
    own = F.col("__off") + F.col("__tail")["__first"] - F.col("__start") + 1
    per = per.withColumns({"__goes": goes_on, "__own": F.when(~whole, own)})
    per = per.withColumn("__carry", F.when(F.col("__goes"), F.last("__own", ignorenulls=True).over(before)))
    small = per.select(_PID, "__off", "__start", "__head", "__carry")  # one row per partition
    joined = parts.join(F.broadcast(small), _PID)
    local = F.col("__off") + F.col("__first") - F.col("__start") + 1
    carried = F.col("__carry").isNotNull() & F.col(metric).eqNullSafe(F.col("__head")[metric])
    return joined.withColumn(name, F.when(carried, F.col("__carry")).otherwise(local)).drop(
        _PID, _POS, "__first", "__off", "__start", "__head", "__carry")


def ordered_pages(rows: DataFrame, group: list[str], at: str, value: str, page_size: int = 1000, grain: str = "day") -> DataFrame:
    """(group, page, values): ARRAY_AGG(value ORDER BY at, value) of each group in pages of at most ``page_size``.

    Page 0 is first. A group of any size is spread over tasks: what is gathered is one
    page, and what is numbered together is one group's rows of one ``grain`` (a unit of
    ``date_trunc``). Rows without a time come last.
    """
    cut = rows.select(*group, F.date_trunc(grain, at).alias("__g"), F.col(at).alias("__at"), F.col(value).alias("__v"))
    counts = cut.groupBy(*group, "__g").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(F.col("__g").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy(*group, "__g").orderBy(F.col("__at").asc_nulls_last(), "__v")
    numbered = cut.withColumn("__k", F.row_number().over(within) - 1).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, "__g")]
    placed = numbered.join(offsets.alias("o"), same).select(
        *[F.col(f"r.{c}").alias(c) for c in group], "__v", (F.col("__off") + F.col("__k")).alias("__seq"))
    return (placed.withColumn("page", F.expr(f"__seq div {page_size}")).groupBy(*group, "page")
            .agg(F.sort_array(F.collect_list(F.struct("__seq", "__v"))).alias("__s"))  # at most a page
            .select(*group, "page", F.transform("__s", lambda s: s["__v"]).alias("values")))
