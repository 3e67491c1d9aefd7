"""Purchase cycle and churn: second-purchase gaps, windows, inactivity status, funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions import date_days_between, pct, ratio, round_half
from retentia.operators.common import PERSON, person_orders, snapshot_date, with_scalar
from retentia.operators.revenue import person_order_summary

# Reported percentiles of the second-purchase gap, the default gap
# bucket edges (days), and the inactivity labels with their day thresholds.
PERCENTILES = (0.5, 0.25, 0.75, 0.90)
WINDOW_EDGES = (7, 30, 90, 180)
CHURN_LABELS = ("Active", "At Risk", "Likely Churned")
CHURN_DAYS = (75, 150)


def second_purchase_gap(o: DataFrame, c: DataFrame, status: str = "delivered") -> DataFrame:
    """Per person with at least two orders: calendar days from the 1st to the 2nd order.

    Orders are first collapsed to (person, purchase day, count) with a partial
    aggregate, so a person's group afterwards holds at most one row per
    calendar day, however many orders the person has. Two orders on the first
    day give a gap of 0; otherwise the gap runs to the next purchase day.
    """
    daily = (person_orders(o, c, status)
             .groupBy(PERSON, F.col("order_purchase_timestamp").cast("date").alias("d"))
             .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(PERSON).orderBy(F.col("d").asc_nulls_last())
    first_two = (daily.withColumn("k", F.row_number().over(w))
                 .where(F.col("k") <= 2)
                 .groupBy(PERSON)
                 .agg(F.max(F.when(F.col("k") == 1, F.col("d"))).alias("d1"),
                      F.max(F.when(F.col("k") == 1, F.col("n"))).alias("n1"),
                      F.max(F.when(F.col("k") == 2, F.col("d"))).alias("d2"),
                      F.max("k").alias("days")))
    gap = (F.when(F.col("d1").isNull(), F.lit(None).cast("int"))
           .when(F.col("n1") >= 2, F.lit(0))
           .otherwise(date_days_between("d2", "d1")))
    return (first_two.where((F.col("n1") >= 2) | (F.col("days") >= 2))
            .select(PERSON, gap.alias("days_between_orders")))


def second_purchase_stats(o: DataFrame, c: DataFrame, min_gap: int | None = None,
                          status: str = "delivered", accuracy: int | None = None) -> DataFrame:
    """Count, mean, exact percentiles (linear interpolation), min and max of the gaps.

    ``min_gap=1`` drops same-day second orders. The exact percentile buffer holds
    one entry per distinct day count, bounded by the calendar span of the data.
    ``accuracy`` switches to ``percentile_approx`` (a bounded sketch, for
    unbounded domains); it returns observed values, without interpolation.
    """
    gaps = second_purchase_gap(o, c, status)
    if min_gap is not None:
        gaps = gaps.where(F.col("days_between_orders") >= min_gap)
    g = F.col("days_between_orders")
    q = (F.percentile(g, list(PERCENTILES)) if accuracy is None
         else F.percentile_approx(g, list(PERCENTILES), accuracy).cast("array<double>"))
    return gaps.agg(
        F.count(F.lit(1)).alias("customers_with_second_purchase"),
        ratio(F.sum(g), F.count(g), 1).alias("avg_days"),
        q.alias("__q"),
        F.min(g).alias("min_days"),
        F.max(g).alias("max_days")).select(
        "customers_with_second_purchase", "avg_days",
        *[F.col("__q")[k].alias(n) for k, n in
          enumerate(("median_days", "p25_days", "p75_days", "p90_days"))],
        "min_days", "max_days")


def window_labels(edges=WINDOW_EDGES) -> list[str]:
    """Bucket labels from the edges: '0-7 days', '8-30 days', ..., '180+ days'."""
    labels, lo = [], 0
    for e in edges:
        labels.append(f"{lo}-{e} days")
        lo = e + 1
    labels.append(f"{edges[-1]}+ days")
    return labels


def purchase_windows(o: DataFrame, c: DataFrame, edges=WINDOW_EDGES, min_gap: int = 1,
                     status: str = "delivered") -> DataFrame:
    """Persons per second-purchase window (same-day repeats excluded by default)."""
    labels = window_labels(edges)
    g = F.col("days_between_orders")
    label = F.lit(labels[-1])
    helper = F.lit(len(labels))
    for k in range(len(edges) - 1, -1, -1):
        label = F.when(g <= edges[k], labels[k]).otherwise(label)
        helper = F.when(g <= edges[k], k + 1).otherwise(helper)
    gaps = second_purchase_gap(o, c, status).where(g >= min_gap)
    return (gaps.groupBy(label.alias("purchase_window"), helper.alias("helper"))
            .agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), "helper"))


def churn_status(o: DataFrame, c: DataFrame, active: int = CHURN_DAYS[0],
                 at_risk: int = CHURN_DAYS[1], status: str = "delivered",
                 labels=CHURN_LABELS) -> DataFrame:
    """Persons by days since their last purchase: Active / At Risk / Likely Churned.

    No payments join: every person with an order of the status counts.
    """
    last = (person_orders(o, c, status).groupBy(PERSON)
            .agg(F.max("order_purchase_timestamp").cast("date").alias("last_purchase_date")))
    days = date_days_between("snapshot_date", "last_purchase_date")
    label = (F.when(days <= active, labels[0]).when(days <= at_risk, labels[1])
             .otherwise(labels[2]))
    return (with_scalar(last, snapshot_date(o))
            .groupBy(label.alias("customer_status"))
            .agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), "customer_status"))


def purchase_funnel(o: DataFrame, c: DataFrame, p: DataFrame, steps: int = 4,
                    status: str = "delivered") -> DataFrame:
    """Persons with at least 1..steps orders, share of the base and drop-off per step.

    Counts are cumulative (>= k orders) at every step.
    """
    per = person_order_summary(o, c, p, status)
    n = F.col("total_orders")
    wide = per.agg(*[F.count_if(n >= k).alias(f"s{k}") for k in range(1, steps + 1)])
    stack = ", ".join(f"{k}, s{k}" for k in range(1, steps + 1))
    long = wide.selectExpr(f"stack({steps}, {stack}) AS (step, customers)")
    prev = F.lag("customers").over(Window.orderBy("step"))  # `steps` rows
    return long.select(
        F.col("step").cast("int").alias("step"), "customers",
        pct("customers", F.first("customers").over(
            Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).alias("pct_of_base"),
        pct(prev - F.col("customers"), prev).alias("drop_off_pct"))


def repeat_rate_opportunity(o: DataFrame, c: DataFrame, p: DataFrame, factor: float = 2.0,
                            status: str = "delivered") -> DataFrame:
    """Extra revenue if the repeat rate were ``factor`` times higher.

    extra persons = repeaters x (factor - 1), each worth the current average
    repeat-person value.
    """
    per = person_order_summary(o, c, p, status)
    rep = F.count_if(F.col("total_orders") > 1)
    rev = F.sum(F.when(F.col("total_orders") > 1, F.col("lifetime_value")))
    agg = per.agg(rep.alias("__rep"), rev.alias("__rev"))
    extra = F.round(F.col("__rep").cast("double") * F.lit(float(factor) - 1.0)).cast("long")
    avg_value = F.col("__rev").cast("double") / F.nullif(F.col("__rep").cast("double"), F.lit(0.0))
    return agg.select(extra.alias("extra_customers"),
                      round_half(avg_value).alias("avg_repeat_customer_value"),
                      round_half(extra.cast("double") * avg_value).alias("extra_revenue"))


def same_day_repeat_share(o: DataFrame, c: DataFrame, status: str = "delivered") -> DataFrame:
    """Repeaters whose second order falls on the day of the first, and their share."""
    gaps = second_purchase_gap(o, c, status)
    same = F.count_if(F.col("days_between_orders") == 0)
    total = F.count(F.lit(1))
    return gaps.agg(total.alias("repeaters"), same.alias("same_day"),
                    pct(same, total).alias("same_day_pct"))
