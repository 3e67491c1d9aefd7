"""Data-quality operators: keys, nulls, orphans, duplicates, reconciliation.

Spark does not enforce PRIMARY KEY / FOREIGN KEY / CHECK on Parquet tables, so
each constraint becomes a check that returns its violations (counts or rows).
All checks are single aggregate passes or explicit anti/semi joins (Catalyst
does not turn LEFT JOIN ... IS NULL into an anti join on its own).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions import avg_of, money
from retentia.operators.common import delivered, item_totals, payment_totals, top_k


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# ------------------------------------------------------------- ingest checks
def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, total_rows) for every table."""
    return _union([df.agg(F.count(F.lit(1)).alias("total_rows"))
                   .select(F.lit(name).alias("table_name"), "total_rows")
                   for name, df in tables.items()])


def row_count_check(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, raw_rows, cleaned_rows, counts_match) for each (raw, cleaned) pair.

    A row-wise load keeps every row; a collapsing one (geolocation) shows
    how many rows it folded.
    """
    return _union([
        raw.agg(F.count(F.lit(1)).alias("raw_rows"))
        .crossJoin(cleaned.agg(F.count(F.lit(1)).alias("cleaned_rows")))  # two one-row counts
        .select(F.lit(name).alias("table_name"), "raw_rows", "cleaned_rows",
                (F.col("raw_rows") == F.col("cleaned_rows")).alias("counts_match"))
        for name, (raw, cleaned) in pairs.items()])


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Total rows and rows beyond the first per distinct value of ``cols``.

    The distinct count is over the row value ``(cols)``, so rows whose key
    holds a NULL still count (unlike COUNT(DISTINCT a, b)).
    """
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_rows"),
                  (total - F.countDistinct(F.struct(*cols))).alias("total_duplicate_rows"))


def dup_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Key values occurring more than once, with their number of occurrences."""
    out = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
           .where(F.col("occurrences") > 1))
    order = [F.col("occurrences").asc(), *[F.col(k).asc() for k in keys]]
    return out.orderBy(*order) if limit is None else top_k(out, limit, *order)


def lookup(df: DataFrame, col: str, value) -> DataFrame:
    """All rows of one key value (pushed into the Parquet scan as a filter)."""
    return df.where(F.col(col) == F.lit(value))


def value_range(df: DataFrame, col: str) -> DataFrame:
    """MIN and MAX of a column."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def null_audit(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, column_name, nulls): one aggregate pass per table, then unpivoted."""
    frames = []
    for name, (df, cols) in tables.items():
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        frames.append(wide.unpivot([], cols, "column_name", "nulls")
                      .select(F.lit(name).alias("table_name"), "column_name", "nulls"))
    return _union(frames)


def id_cardinality(c: DataFrame, id_col: str = "customer_id",
                   person_col: str = "customer_unique_id") -> DataFrame:
    """Transaction ids vs distinct persons."""
    return c.agg(F.count(id_col).alias("total_order_ids"),
                 F.countDistinct(person_col).alias("actual_human_customers"))


def shared_reviews(r: DataFrame, limit: int | None = 20) -> DataFrame:
    """Review rows whose review_id is attached to more than one order."""
    shared = (r.groupBy("review_id").agg(F.countDistinct("order_id").alias("__n"))
              .where(F.col("__n") > 1).select("review_id"))
    rows = (r.join(shared, "review_id", "left_semi")
            .select("review_id", "order_id", "review_score", "review_comment_message"))
    return top_k(rows, limit, F.col("review_id").asc(), F.col("order_id").asc())


def composite_key_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows vs distinct row values of a candidate composite key."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.countDistinct(F.struct(*cols)).alias("distinct_keys"))


def orphan_audit(fks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(fk, orphans): child rows whose key has no parent row, per foreign key.

    A NULL child key counts as an orphan, as in LEFT JOIN ... WHERE parent IS NULL.
    """
    frames = []
    for name, child, ckey, parent, pkey in fks:
        parents = parent.select(F.col(pkey).alias("__k"))
        n = (child.select(F.col(ckey).alias("__k")).join(parents, "__k", "left_anti")
             .agg(F.count(F.lit(1)).alias("orphans")))
        frames.append(n.select(F.lit(name).alias("fk"), "orphans"))
    return _union(frames)


def ghost_orders(o: DataFrame, i: DataFrame, status: str | None = "delivered") -> DataFrame:
    """Orders of a status that have no item."""
    return (delivered(o, status).select("order_id", "order_status")
            .join(i.select("order_id").distinct(), "order_id", "left_anti"))


def _reconcile(i: DataFrame, p: DataFrame, tolerance: float) -> DataFrame:
    pays = p.groupBy("order_id").agg(
        money(F.sum("payment_value")).alias("pay_sum"),
        F.count_if(F.col("payment_type") == "voucher").alias("voucher_count"),
        F.max("payment_installments").alias("payment_installments"))
    items = item_totals(i).select("order_id", "item_sum")
    gap = F.abs(F.col("item_sum") - F.col("pay_sum"))
    return (items.join(pays, "order_id")
            .withColumn("discrepancy", money(gap))
            .where(gap > F.lit(tolerance).cast("decimal(18,2)")))


def payment_reconciliation(i: DataFrame, p: DataFrame, tolerance: float = 1.00) -> DataFrame:
    """Orders whose item total and payment total differ by more than ``tolerance``."""
    return _reconcile(i, p, tolerance).select("order_id", "item_sum", "pay_sum", "discrepancy")


def payment_reconciliation_voucher(i: DataFrame, p: DataFrame, tolerance: float = 1.00,
                                   ordered: bool = True) -> DataFrame:
    """The reconciliation gaps with the number of voucher payments, largest gap first."""
    out = _reconcile(i, p, tolerance).select("order_id", "item_sum", "pay_sum",
                                             "voucher_count", "discrepancy")
    return out.orderBy(F.col("discrepancy").desc(), "order_id") if ordered else out


def discrepancy_by_installments(i: DataFrame, p: DataFrame, tolerance: float = 1.00) -> DataFrame:
    """Reconciliation gaps grouped by the order's largest installment count."""
    gaps = _reconcile(i, p, tolerance)
    return (gaps.groupBy("payment_installments")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 avg_of(F.sum("discrepancy"), F.count("discrepancy")).alias("avg_discrepancy"))
            .orderBy(F.col("payment_installments").desc()))


def orders_without_items_by_status(o: DataFrame, i: DataFrame) -> DataFrame:
    """Orders without any item, counted per status."""
    return (ghost_orders(o, i, None).groupBy("order_status")
            .agg(F.count(F.lit(1)).alias("total_orders")))


def multi_method_payments(p: DataFrame) -> DataFrame:
    """Payment rows of orders paid with more than one payment type."""
    multi = (p.groupBy("order_id").agg(F.countDistinct("payment_type").alias("__n"))
             .where(F.col("__n") > 1).select("order_id"))
    return (p.join(multi, "order_id", "left_semi")
            .select("order_id", "payment_sequential", "payment_type", "payment_value")
            .orderBy("order_id", "payment_sequential"))


def impossible_dates(o: DataFrame, lower: str = "2016-01-01", as_of: str | None = None,
                     col: str = "order_purchase_timestamp") -> DataFrame:
    """Orders dated after ``as_of`` (default: now) or before ``lower``."""
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None \
        else F.lit(as_of).cast("timestamp_ntz")
    ts = F.col(col)
    return o.where((ts > now) | (ts < F.lit(lower).cast("timestamp_ntz"))) \
        .agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------ declarative checks
def check_constraints(df: DataFrame, not_null=(), non_negative=(), between=(),
                      max_length=(), table: str = "") -> DataFrame:
    """Count violations of column constraints in one aggregate pass.

    ``between`` holds (column, low, high) (NULL passes, as in SQL CHECK),
    ``max_length`` holds (column, n). Returns (table_name, constraint, violations).
    """
    checks = []
    for c in not_null:
        checks.append((f"not_null({c})", F.count_if(F.col(c).isNull())))
    for c in non_negative:
        checks.append((f"non_negative({c})", F.count_if(F.col(c) < 0)))
    for c, lo, hi in between:
        checks.append((f"between({c},{lo},{hi})", F.count_if(~F.col(c).between(lo, hi))))
    for c, n in max_length:
        checks.append((f"max_length({c},{n})", F.count_if(F.length(F.col(c)) > n)))
    if not checks:
        raise ValueError("no constraint given")
    names = [f"__c{k}" for k in range(len(checks))]
    wide = df.agg(*[expr.alias(n) for n, (_, expr) in zip(names, checks)])
    stacked = ", ".join(f"'{label}', {n}" for n, (label, _) in zip(names, checks))
    return wide.selectExpr(f"'{table}' AS table_name",
                           f"stack({len(checks)}, {stacked}) AS (constraint, violations)")


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are NULL or not unique (PRIMARY KEY)."""
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"),
                                 F.max(nulls.cast("int")).alias("__null")) \
        .where((F.col("occurrences") > 1) | (F.col("__null") == 1)).drop("__null")


def foreign_key_violations(child: DataFrame, ckey: str, parent: DataFrame, pkey: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent (FOREIGN KEY); returns the rows."""
    return (child.where(F.col(ckey).isNotNull())
            .join(parent.select(F.col(pkey).alias(ckey)).distinct(), ckey, "left_anti"))
