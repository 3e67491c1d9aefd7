"""Shared building blocks of the analytics operators.

Conventions

* Role DataFrames follow the cleaned schemas (``retentia.sources.schemas``).
  ``orders.order_id`` and ``customers.customer_id`` are primary keys (checked
  by ``retentia.operators.quality``), so after the one-to-many sides are
  collapsed to order grain ``count(*)`` counts distinct orders; that removes
  the extra shuffle ``COUNT(DISTINCT order_id)`` would cost.
* One-to-many sides (payments, items) are aggregated to order grain *before*
  they are joined (eager aggregation), so no join fans out.
* Per-person facts are aggregated per person *before* they meet a
  per-person label, so a person with a huge share of all orders never sends
  its rows through one join or window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions import money

PERSON = "customer_unique_id"


def delivered(o: DataFrame, status: str | None = "delivered") -> DataFrame:
    """Orders of one status (``None`` keeps all statuses)."""
    return o if status is None else o.where(F.col("order_status") == F.lit(status))


def payment_totals(p: DataFrame, name: str = "total_paid") -> DataFrame:
    """One row per order: SUM(payment_value) as money."""
    return p.groupBy("order_id").agg(money(F.sum("payment_value")).alias(name))


def item_totals(i: DataFrame) -> DataFrame:
    """One row per order: product revenue, freight revenue and their sum."""
    return i.groupBy("order_id").agg(
        money(F.sum("price")).alias("product_revenue"),
        money(F.sum("freight_value")).alias("freight_revenue"),
        money(F.sum(F.col("price") + F.col("freight_value"))).alias("item_sum"))


def person_orders(o: DataFrame, c: DataFrame, status: str | None = "delivered",
                  columns: tuple[str, ...] = ("order_purchase_timestamp",)) -> DataFrame:
    """Orders of a status with the person key attached (inner join on customer_id).

    When the orders table already carries the person key (the cleaned layer
    resolves it once at load, under the customers primary key), the join is
    replaced by dropping orders without a person, which is the same result and
    saves a join of the two largest tables in every person-level query.
    """
    cols = ["order_id", "customer_id", *columns]
    sel = delivered(o, status)
    if PERSON in o.columns:
        return (sel.where(F.col(PERSON).isNotNull())
                .select(*dict.fromkeys(cols), PERSON))
    return (sel.select(*dict.fromkeys(cols))
            .join(c.select("customer_id", PERSON), "customer_id"))


def snapshot_date(o: DataFrame, name: str = "snapshot_date") -> DataFrame:
    """One-row relation: latest purchase date over orders of *all* statuses."""
    return o.agg(F.max("order_purchase_timestamp").cast("date").alias(name))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row relation to every row.

    The one-row side has a proven size bound, so it is broadcast; the plan is a
    broadcast nested-loop join without any shuffle of ``df``.
    """
    return df.crossJoin(F.broadcast(one_row))


def person_order_counts(o: DataFrame, c: DataFrame, status: str | None = "delivered",
                        name: str = "total_orders") -> DataFrame:
    """Per person: number of (distinct) orders of a status."""
    return person_orders(o, c, status, ()).groupBy(PERSON).agg(F.count(F.lit(1)).alias(name))


def grand_total(col: str) -> Column:
    """``SUM(col) OVER ()``: only used on relations bounded by a dimension (months, states, categories)."""
    return F.sum(col).over(Window.partitionBy())


def top_k(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """ORDER BY ... LIMIT k (a TakeOrderedAndProject, no full sort); ``k=None`` keeps all rows."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)
