"""Revenue and business-performance operators (KPIs, trends, categories, Pareto)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions import avg_of, extract_days_between, money, pct, ratio
from retentia.operators.common import (
    PERSON, delivered, grand_total, item_totals, payment_totals, person_orders, top_k,
)
from retentia.operators.ntile import global_row_number
from retentia.operators.ordering import ordered_pages

# Label of untranslated categories, Pareto labels and threshold (%).
UNKNOWN_CATEGORY = "Unknown"
PARETO_LABELS = ("Top 80% Revenue Drivers", "Long Tail")
PARETO_THRESHOLD = 80.0


def order_total_vs_paid(i: DataFrame, p: DataFrame, order_id) -> DataFrame:
    """For one order: SUM(price + freight) next to SUM(payment_value)."""
    items = (i.where(F.col("order_id") == F.lit(order_id))
             .agg(money(F.sum(F.col("price") + F.col("freight_value"))).alias("calculated_total")))
    paid = (p.where(F.col("order_id") == F.lit(order_id))
            .agg(money(F.sum("payment_value")).alias("actual_payment")))
    return items.crossJoin(paid)  # two one-row aggregates


def naive_overview(o: DataFrame, p: DataFrame, customers: DataFrame | None = None,
                   status: str = "delivered") -> DataFrame:
    """Overview over *payment rows* (kept as the contrast: AVG is per payment row).

    Without ``customers`` the customer count is over the transaction id
    ``customer_id``; with it, over the person id. Payments are first summed
    per order together with their row count, so the average per payment row is
    exact and only one distinct count (customers) remains.
    """
    per_order = p.groupBy("order_id").agg(F.sum("payment_value").alias("__v"),
                                          F.count("payment_value").alias("__n"))
    if customers is None:
        orders, who = delivered(o, status).select("order_id", "customer_id", "order_purchase_timestamp"), "customer_id"
    else:
        orders, who = person_orders(o, customers, status), PERSON
    return orders.join(per_order, "order_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct(who).alias("total_customers"),
        money(F.sum("__v")).alias("total_revenue"),
        avg_of(F.sum("__v"), F.sum("__n")).alias("avg_order_value"),
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"))


def revenue_overview(o: DataFrame, c: DataFrame, i: DataFrame, p: DataFrame,
                     status: str = "delivered") -> DataFrame:
    """Orders, persons, product/freight revenue, cash received, AOV, orders per person.

    Items and payments are each collapsed to order grain before the left joins.
    """
    sel = delivered(o, status)
    if PERSON in o.columns:  # resolved at load; orders without a person keep a null there
        named = sel.select("order_id", PERSON)
    else:
        named = sel.select("order_id", "customer_id").join(c.select("customer_id", PERSON), "customer_id", "left")
    base = (named.join(item_totals(i).drop("item_sum"), "order_id", "left")
            .join(payment_totals(p), "order_id", "left"))
    orders = F.count(F.lit(1))
    persons = F.countDistinct(PERSON)
    return base.agg(
        orders.alias("total_orders"),
        persons.alias("total_unique_customers"),
        money(F.sum("product_revenue")).alias("total_product_revenue"),
        money(F.sum("freight_revenue")).alias("total_freight_revenue"),
        money(F.sum("total_paid")).alias("total_cash_received"),
        ratio(F.sum("total_paid"), orders).alias("avg_order_value"),
        ratio(orders, persons).alias("orders_per_customer"))


def delivered_counts(o: DataFrame, status: str = "delivered") -> DataFrame:
    """Number of orders of a status and of distinct transaction ids."""
    return delivered(o, status).agg(F.count(F.lit(1)).alias("orders"),
                                    F.countDistinct("customer_id").alias("customer_ids"))


def customers_multi_orders(o: DataFrame, key: str = "customer_id", limit: int | None = 20,
                           status: str = "delivered") -> DataFrame:
    """Keys with more than one order of a status, most orders first."""
    counts = (delivered(o, status).groupBy(key).agg(F.count(F.lit(1)).alias("order_count"))
              .where(F.col("order_count") > 1))
    return top_k(counts, limit, F.col("order_count").desc(), F.col(key).asc())


def orders_per_customer(o: DataFrame) -> DataFrame:
    """All statuses: orders, distinct transaction ids and their ratio."""
    orders = F.count(F.lit(1))
    ids = F.countDistinct("customer_id")
    return o.agg(orders.alias("total_orders"), ids.alias("total_customers"),
                 ratio(orders, ids).alias("orders_per_customer"))


def multi_order_customers(o: DataFrame, c: DataFrame, limit: int = 10,
                          status: str = "delivered", as_array: bool = False) -> DataFrame:
    """Persons with more than one order: counts and their orders in purchase order.

    The top ``limit`` persons (most orders first, then person key) are chosen
    from per-person counts; that set has a proven size bound and is broadcast.
    Their orders come back one row per order with ``order_seq`` (1 = first
    purchase), numbered by a distributed global row number, so no person's
    orders are ever gathered in one task. ``as_array=True`` folds them into
    ``order_ids`` as in ARRAY_AGG(order_id ORDER BY purchase time); use it only
    when no person has an unbounded number of orders.
    """
    po = person_orders(o, c, status)
    counts = (po.groupBy(PERSON).agg(F.count(F.lit(1)).alias("total_orders"),
                                      F.countDistinct("customer_id").alias("unique_customer_ids"))
              .where(F.col("total_orders") > 1))
    chosen = counts.orderBy(F.col("total_orders").desc(), F.col(PERSON).asc()).limit(limit)
    rows = po.join(F.broadcast(chosen), PERSON)
    numbered = global_row_number(
        rows, [F.col(PERSON), F.col("order_purchase_timestamp").asc_nulls_last(), F.col("order_id")],
        "__g")
    first = numbered.groupBy(PERSON).agg(F.min("__g").alias("__g0"))
    out = (numbered.join(F.broadcast(first), PERSON)
           .select(PERSON, "total_orders", "unique_customer_ids",
                   (F.col("__g") - F.col("__g0") + 1).alias("order_seq"), "order_id"))
    if not as_array:
        return out
    return (out.groupBy(PERSON, "total_orders", "unique_customer_ids")
            .agg(F.sort_array(F.collect_list(F.struct("order_seq", "order_id"))).alias("__s"))
            .select(PERSON, "total_orders", "unique_customer_ids",
                    F.transform("__s", lambda s: s["order_id"]).alias("order_ids")))


def multi_order_pages(o: DataFrame, c: DataFrame, limit: int = 10, status: str = "delivered",
                      page_size: int = 1000) -> DataFrame:
    """Persons with more than one order: counts and ``order_ids`` in purchase order, as ARRAY_AGG gives them.

    A person with more than ``page_size`` orders has several rows, page 0 first, so no
    array grows without bound; the top ``limit`` persons are chosen from per-person counts.
    """
    po = person_orders(o, c, status)
    counts = (po.groupBy(PERSON).agg(F.count(F.lit(1)).alias("total_orders"),
                                      F.countDistinct("customer_id").alias("unique_customer_ids"))
              .where(F.col("total_orders") > 1))
    chosen = top_k(counts, limit, F.col("total_orders").desc(), F.col(PERSON).asc())
    rows = po.join(chosen.select(PERSON), PERSON, "left_semi")
    pages = ordered_pages(rows, [PERSON], "order_purchase_timestamp", "order_id", page_size)
    return pages.join(chosen, PERSON).select(
        PERSON, "total_orders", "unique_customer_ids", "page", F.col("values").alias("order_ids"))


def executive_summary(o: DataFrame, c: DataFrame, p: DataFrame,
                      status: str = "delivered") -> DataFrame:
    """Core KPIs: orders, persons, revenue, AOV (revenue / orders), orders per person, period.

    Payments are collapsed per order first, so split payments do not deflate AOV.
    """
    base = (person_orders(o, c, status)
            .join(payment_totals(p, "total_order_value"), "order_id"))
    orders = F.count(F.lit(1))
    persons = F.countDistinct(PERSON)
    revenue = F.sum("total_order_value")
    return base.agg(
        orders.alias("total_orders"),
        persons.alias("total_unique_customers"),
        money(revenue).alias("total_revenue"),
        ratio(revenue, orders).alias("avg_order_value"),
        ratio(orders, persons).alias("orders_per_customer"),
        F.min("order_purchase_timestamp").cast("date").alias("period_start"),
        F.max("order_purchase_timestamp").cast("date").alias("period_end"))


def monthly_trends(o: DataFrame, p: DataFrame, grain: str = "month",
                   status: str = "delivered") -> DataFrame:
    """Per period: orders, revenue, AOV and growth against the previous *existing* period.

    Left join to payments: an unpaid order counts as an order with no revenue.
    The LAG runs over the aggregated periods only (bounded by the calendar).
    """
    period = F.date_trunc(grain, F.col("order_purchase_timestamp")).cast("date")
    monthly = (delivered(o, status).select("order_id", "order_purchase_timestamp")
               .join(payment_totals(p), "order_id", "left")
               .groupBy(period.alias("purchase_month"))
               .agg(F.count(F.lit(1)).alias("total_orders"),
                    money(F.sum("total_paid")).alias("monthly_revenue")))
    prev = F.lag("monthly_revenue").over(Window.orderBy(F.col("purchase_month").asc_nulls_last()))
    return monthly.select(
        "purchase_month", "total_orders", "monthly_revenue",
        ratio("monthly_revenue", "total_orders").alias("avg_order_value"),
        pct(F.col("monthly_revenue") - prev, prev).alias("revenue_growth_pct")).orderBy(F.col("purchase_month").asc_nulls_last())


def category_gmv(i: DataFrame, pr: DataFrame, tr: DataFrame, limit: int | None = 20,
                 unknown: str = UNKNOWN_CATEGORY) -> DataFrame:
    """Item GMV (price + freight) per translated category, share of the total GMV.

    The share is of *all* categories (computed before the limit). The fact
    meets the product dimension first and the translation second.
    """
    gmv = F.col("price") + F.col("freight_value")
    items = i.select("order_id", "product_id", gmv.alias("gmv"))
    per_cat = (items.join(pr.select("product_id", "product_category_name"), "product_id")
               .join(tr, "product_category_name", "left")
               .groupBy(F.coalesce("product_category_name_english", F.lit(unknown)).alias("category"))
               .agg(F.countDistinct("order_id").alias("orders"),
                    money(F.sum("gmv")).alias("item_revenue"),
                    avg_of(F.sum("gmv"), F.count("gmv")).alias("avg_item_value")))
    shared = per_cat.withColumn("pct_of_total_gmv", pct("item_revenue", grand_total("item_revenue")))
    return top_k(shared, limit, F.col("item_revenue").desc(), F.col("category").asc())


def person_order_summary(o: DataFrame, c: DataFrame, p: DataFrame,
                         status: str = "delivered") -> DataFrame:
    """Per person (orders with a payment and a purchase time): orders, first/last purchase, value."""
    base = (person_orders(o, c, status)
            .where(F.col("order_purchase_timestamp").isNotNull())
            .join(payment_totals(p), "order_id"))
    return base.groupBy(PERSON).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.max("order_purchase_timestamp").alias("last_order_date"),
        money(F.sum("total_paid")).alias("lifetime_value"))


def repeat_customer_analysis(o: DataFrame, c: DataFrame, p: DataFrame,
                             status: str = "delivered") -> DataFrame:
    """One row of 17 figures: one-time vs repeat persons, orders, span, revenue split."""
    pcs = person_order_summary(o, c, p, status)
    n = F.col("total_orders")
    ltv = F.col("lifetime_value")
    total = F.count(F.lit(1))
    one = F.count_if(n == 1)
    rep = F.count_if(n > 1)
    rev = F.sum(ltv)
    rev_one = F.sum(F.when(n == 1, ltv).otherwise(F.lit(0)))
    rev_rep = F.sum(F.when(n > 1, ltv).otherwise(F.lit(0)))
    span = extract_days_between("last_order_date", "first_order_date")
    return pcs.agg(
        total.alias("total_customers"),
        one.alias("one_time_customers"),
        F.count_if(n == 2).alias("two_order_customers"),
        F.count_if(n == 3).alias("three_order_customers"),
        F.count_if(n >= 4).alias("four_plus_customers"),
        pct(one, total).alias("one_time_pct"),
        pct(rep, total).alias("repeat_rate_pct"),
        avg_of(F.sum(n), total).alias("avg_orders_per_customer"),
        F.max(n).alias("max_orders_single_customer"),
        avg_of(F.sum(F.when(n > 1, span)), F.count(F.when(n > 1, span)), 1)
        .alias("avg_days_between_first_last_order"),
        money(rev).alias("total_revenue"),
        money(rev_one).alias("one_time_revenue"),
        money(rev_rep).alias("repeat_customer_revenue"),
        pct(rev_one, rev).alias("one_time_revenue_pct"),
        pct(rev_rep, rev).alias("repeat_revenue_pct"),
        avg_of(F.sum(F.when(n == 1, ltv)), F.count(F.when(n == 1, ltv))).alias("avg_one_time_customer_value"),
        avg_of(F.sum(F.when(n > 1, ltv)), F.count(F.when(n > 1, ltv))).alias("avg_repeat_customer_value"))


def state_pareto(o: DataFrame, c: DataFrame, p: DataFrame, by: str = "state",
                 threshold: float = PARETO_THRESHOLD, status: str = "delivered",
                 top_label: str = PARETO_LABELS[0],
                 tail_label: str = PARETO_LABELS[1]) -> DataFrame:
    """Revenue per region with share, cumulative share and a Pareto label.

    The label compares the *rounded* cumulative share with ``threshold``. The
    windows run over one row per region (bounded by the dimension).
    """
    base = (delivered(o, status).select("order_id", "customer_id", "order_purchase_timestamp")
            .where(F.col("order_purchase_timestamp").isNotNull())
            .join(c.select("customer_id", PERSON, by), "customer_id")
            .join(payment_totals(p), "order_id"))
    orders = F.count(F.lit(1))
    persons = F.countDistinct(PERSON)
    per = base.groupBy(by).agg(
        persons.alias("unique_customers"),
        orders.alias("total_orders"),
        money(F.sum("total_paid")).alias("total_revenue"),
        avg_of(F.sum("total_paid"), orders).alias("avg_order_value"),
        ratio(orders, persons).alias("orders_per_customer"))
    running = F.sum("total_revenue").over(
        Window.orderBy(F.col("total_revenue").desc(), F.col(by).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = grand_total("total_revenue")
    framed = per.select("*", pct("total_revenue", total).alias("pct_of_total_revenue"),
                        pct(running, total).alias("cumulative_revenue_pct"))
    return framed.withColumn(
        "pareto_segment",
        F.when(F.col("cumulative_revenue_pct") <= F.lit(threshold), top_label).otherwise(tail_label)).orderBy(
        F.col("total_revenue").desc(), F.col(by).asc())
