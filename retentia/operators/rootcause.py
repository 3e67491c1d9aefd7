"""Retention root cause: delivery, reviews, categories, seller handoff, freight.

Pattern used throughout: every order-level fact is first aggregated *per
person* (partial, map-side aggregation), and only that one-row-per-person
summary meets the person's label (segment or one-time/repeat group). A person
who owns a large share of all orders therefore never routes those rows through
a single join or window task; the label joins are one-to-one on the person key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions import (
    avg_of, extract_days_between, micros_between, pct, percentile_from_histogram, round_half,
)
from retentia.operators.common import PERSON, person_orders, top_k
from retentia.operators.rfm import SEGMENTS, hybrid_table

# Group labels used by the reference's comparisons.
DELIVERY_GROUPS = ("Repeat (3%)", "One-Time (97%)")
REVIEW_GROUPS = ("Repeat Customer (3%)", "One-Time Buyer (97%)")
CATEGORY_GROUPS = ("Repeat", "One-Time")
HANDOFF_GROUPS = ("3% Repeaters", "97% One-Timers")
VIP_LABEL = {"champions": "VIP Elite"}
SEGMENT_ORDER = ("Lapsed - Recovery Target", "VIP Elite", "Active & Engaged",
                 "Active - Needs Nurturing", "Churned")
REVIEW_SCORES = (1, 2, 3, 4, 5)
_MICROS_PER_DAY = 86400000000


def _repeat_label(n, labels):
    return F.when(n > 1, labels[0]).otherwise(labels[1])


def hybrid_segments(o, c, p, status="delivered", labels=VIP_LABEL) -> DataFrame:
    """(person, segment) from the hybrid RFM with the root-cause label set."""
    return relabelled(hybrid_table(o, c, p, status=status), labels)


def relabelled(hybrid: DataFrame, labels=VIP_LABEL) -> DataFrame:
    """(person, segment) of a table of ``rfm.hybrid_table`` with other segment names."""
    name = F.col("segment")
    for key, label in labels.items():
        name = F.when(F.col("segment") == SEGMENTS[key], label).otherwise(name)
    return hybrid.select(PERSON, name.alias("segment"))


# ------------------------------------------------------------------ delivery
def _delivery_per_person(o: DataFrame, c: DataFrame, status: str) -> DataFrame:
    """Per person: all orders of the status, and sums over those with both delivery dates."""
    po = person_orders(o, c, status, ("order_purchase_timestamp", "order_delivered_customer_date",
                                      "order_estimated_delivery_date"))
    have = F.col("order_delivered_customer_date").isNotNull() & \
        F.col("order_estimated_delivery_date").isNotNull()
    actual = extract_days_between("order_delivered_customer_date", "order_purchase_timestamp")
    est = extract_days_between("order_estimated_delivery_date", "order_purchase_timestamp")
    delay = extract_days_between("order_delivered_customer_date", "order_estimated_delivery_date")
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    on = lambda x: F.when(have, x)
    return po.groupBy(PERSON).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.count_if(have).alias("n"),
        F.sum(on(actual)).alias("s_act"), F.count(on(actual)).alias("c_act"),
        F.sum(on(est)).alias("s_est"), F.count(on(est)).alias("c_est"),
        F.count_if(have & late).alias("late"),
        F.sum(F.when(have & late, delay)).alias("s_delay"),
        F.count(F.when(have & late, delay)).alias("c_delay"),
        F.max(F.when(have & late, delay)).alias("max_delay"))


def _delivery_metrics(per: DataFrame, group: str, digits: int, with_max: bool) -> DataFrame:
    per = per.where(F.col("n") > 0)
    n = F.sum("n")
    aggs = [n.alias("total_orders"),
            avg_of(F.sum("s_act"), F.sum("c_act"), digits).alias("avg_actual_delivery_days"),
            avg_of(F.sum("s_est"), F.sum("c_est"), digits).alias("avg_estimated_delivery_days"),
            F.sum("late").alias("late_deliveries"),
            pct(F.sum("late"), n).alias("late_delivery_pct"),
            avg_of(F.sum("s_delay"), F.sum("c_delay"), digits).alias("avg_delay_when_late")]
    if with_max:
        aggs.append(F.max("max_delay").alias("max_delay_days"))
    aggs.append(pct(n - F.sum("late"), n).alias("on_time_pct"))
    return per.groupBy(group).agg(*aggs)


def delivery_by_segment(o: DataFrame, c: DataFrame, p: DataFrame, status: str = "delivered",
                        digits: int = 1, segments: DataFrame | None = None) -> DataFrame:
    """Delivery speed and lateness per hybrid RFM segment (repeat persons).

    ``segments`` (person, segment) reuses segments that are already computed.
    """
    if segments is None:
        segments = hybrid_segments(o, c, p, status)
    per = _delivery_per_person(o, c, status).join(segments, PERSON)
    out = _delivery_metrics(per, "segment", digits, with_max=True)
    rank = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(SEGMENT_ORDER, 1))):
        rank = F.when(F.col("segment") == name, k).otherwise(rank)
    return out.orderBy(rank.asc_nulls_last(), "segment")


def delivery_one_time_vs_repeat(o: DataFrame, c: DataFrame, status: str = "delivered",
                                digits: int = 2, labels=DELIVERY_GROUPS) -> DataFrame:
    """The delivery metrics for repeat vs one-time persons (no max)."""
    per = _delivery_per_person(o, c, status).withColumn(
        "customer_group", _repeat_label(F.col("frequency"), labels))
    return _delivery_metrics(per, "customer_group", digits, with_max=False)


# ------------------------------------------------------------------- reviews
def reviews_one_time_vs_repeat(o: DataFrame, c: DataFrame, r: DataFrame,
                               status: str = "delivered", labels=REVIEW_GROUPS,
                               scores=REVIEW_SCORES) -> DataFrame:
    """Review coverage, mean/median score and star distribution per group.

    Reviews are summed per order, orders per person, persons per group; the
    score histogram (scores are constrained to 1..5) carries the exact median.
    """
    s = F.col("review_score")
    per_order = r.groupBy("order_id").agg(
        F.count(s).alias("r_n"), F.sum(s).alias("r_sum"),
        *[F.count_if(s == k).alias(f"r_{k}") for k in scores])
    cols = ["r_n", "r_sum"] + [f"r_{k}" for k in scores]
    per_person = (person_orders(o, c, status, ())
                  .join(per_order, "order_id", "left")
                  .groupBy(PERSON)
                  .agg(F.count(F.lit(1)).alias("orders"),
                       F.count_if(F.col("r_n") > 0).alias("with_review"),
                       *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in cols]))
    typed = per_person.withColumn("customer_type", F.when(F.col("orders") == 1, labels[1])
                                  .otherwise(labels[0]))
    g = typed.groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("orders").alias("total_orders"),
        F.sum("with_review").alias("orders_with_reviews"),
        *[F.sum(x).alias(x) for x in cols])
    n = F.col("r_n")
    low = sum((F.col(f"r_{k}") for k in scores if k <= 2), F.lit(0))
    # exact median from the score histogram, in the same pass (no second branch)
    median = percentile_from_histogram(list(scores), [f"r_{k}" for k in scores], 0.5)
    return g.select(
        "customer_type", "total_customers", "total_orders", "orders_with_reviews",
        pct("orders_with_reviews", "total_orders").alias("review_rate_pct"),
        avg_of("r_sum", n).alias("avg_review_score"),
        round_half(median, 1).alias("median_review_score"),
        *[pct(f"r_{k}", n).alias(f"pct_{k}_star") for k in sorted(scores, reverse=True)],
        low.alias("negative_reviews"),
        pct(low, n).alias("negative_review_pct"),
        n.alias("total_reviews")).orderBy(F.when(F.col("customer_type") == labels[0], 1).otherwise(2))


# ---------------------------------------------------------------- categories
def with_category(fact: DataFrame, pr: DataFrame, tr: DataFrame, fallback_native: bool = True,
                  unknown: str = "Unknown", inner: bool = False) -> DataFrame:
    """Attach ``category`` to rows carrying ``product_id``.

    English name, else native name, else 'Unknown'; ``inner=True`` keeps only
    translated products. The fact meets the product dimension first and the
    (category-sized) translation second, so size estimates stay per table.
    """
    j = (fact.join(pr.select("product_id", "product_category_name"), "product_id")
         .join(tr, "product_category_name", "inner" if inner else "left"))
    if inner:
        cat = F.col("product_category_name_english")
    else:
        parts = ["product_category_name_english"] + (["product_category_name"] if fallback_native else [])
        cat = F.coalesce(*parts, F.lit(unknown))
    return j.withColumn("category", cat).drop("product_category_name", "product_category_name_english")


def _person_categories(o, c, i, pr, tr, status) -> DataFrame:
    """(person, category, orders): distinct orders per person and category."""
    items = with_category(i.select("order_id", "product_id"), pr, tr)
    return (person_orders(o, c, status, ())
            .join(items, "order_id")
            .groupBy(PERSON, "category")
            .agg(F.countDistinct("order_id").alias("orders")))


def top_categories(o: DataFrame, c: DataFrame, i: DataFrame, pr: DataFrame, tr: DataFrame,
                   k: int = 5, status: str = "delivered", labels=CATEGORY_GROUPS) -> DataFrame:
    """Top-k categories by distinct persons for repeat and one-time persons, side by side."""
    freq = person_orders(o, c, status, ()).groupBy(PERSON).agg(F.count(F.lit(1)).alias("frequency"))
    pc = _person_categories(o, c, i, pr, tr, status)
    typed = pc.join(freq, PERSON).withColumn(
        "customer_type", _repeat_label(F.col("frequency"), labels))
    counts = typed.groupBy("customer_type", "category").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("orders").alias("order_count"))
    w = Window.partitionBy("customer_type").orderBy(F.col("customer_count").desc(),
                                                    F.col("category").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rep, one = labels

    def pick(t, col):
        return F.max(F.when(F.col("customer_type") == t, F.col(col)))

    return ranked.groupBy("rank").agg(
        pick(rep, "category").alias("repeat_top_category"),
        pick(rep, "customer_count").alias("repeat_customers"),
        pick(rep, "order_count").alias("repeat_orders"),
        pick(one, "category").alias("onetime_top_category"),
        pick(one, "customer_count").alias("onetime_customers"),
        pick(one, "order_count").alias("onetime_orders")).orderBy("rank")


def top_category_overlap(o, c, i, pr, tr, k: int = 5, status: str = "delivered") -> DataFrame:
    """How many of the top-k categories the repeat and one-time groups share."""
    side = top_categories(o, c, i, pr, tr, k, status)
    # one pass over the k rows: a shared category occurs once in either column
    both = side.select(F.explode(F.array("repeat_top_category", "onetime_top_category")).alias("category"))
    return (both.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count_if(F.col("n") == 2).alias("shared_categories")))


def _first_category_rates(o, c, i, pr, tr, min_customers, status) -> DataFrame:
    """Per first-purchase category: persons, repeaters, repeat rate (>= min_customers persons).

    The first purchase is the first item of the earliest order that has an item of a
    known product (ties by order and item id). The order is found from order rows
    alone; only the items of first orders meet the product tables.
    """
    po = person_orders(o, c, status)
    freq = po.groupBy(PERSON).agg(F.count(F.lit(1)).alias("total_orders"))
    lines = i.select("order_id", "order_item_id", "product_id")
    filled = lines.join(pr.select("product_id"), "product_id", "left_semi").select("order_id")
    first_order = (po.join(filled, "order_id", "left_semi")
                   .groupBy(PERSON)
                   .agg(F.min(F.struct(F.col("order_purchase_timestamp").isNull(), "order_purchase_timestamp", "order_id"))["order_id"]
                        .alias("order_id")))
    items = with_category(lines.join(first_order, "order_id"), pr, tr)
    firsts = items.groupBy(PERSON).agg(F.min(F.struct("order_item_id", "category"))["category"].alias("category"))
    n = F.count(F.lit(1))
    rep = F.count_if(F.col("total_orders") > 1)
    return (firsts.join(freq, PERSON)
            .groupBy("category")
            .agg(n.alias("total_customers"), rep.alias("repeat_customers"),
                 pct(rep, n).alias("repeat_rate_pct"))
            .where(F.col("total_customers") >= min_customers))


def category_repeat_rate_ranked(o, c, i, pr, tr, min_customers: int = 100, limit: int | None = 20,
                                status: str = "delivered") -> DataFrame:
    """First-purchase categories by repeat rate, with RANKs by rate and by volume."""
    rates = _first_category_rates(o, c, i, pr, tr, min_customers, status)
    ranked = rates.select(
        "*",
        F.rank().over(Window.orderBy(F.col("repeat_rate_pct").desc())).alias("repeat_rate_rank"),
        F.rank().over(Window.orderBy(F.col("total_customers").desc())).alias("volume_rank"))
    return top_k(ranked, limit, F.col("repeat_rate_pct").desc(), F.col("category").asc())


def category_repeat_rate_vs_baseline(o, c, i, pr, tr, min_customers: int = 100,
                                     baseline: float = 3.0, limit: int | None = 20,
                                     status: str = "delivered") -> DataFrame:
    """First-purchase categories by repeat rate and their distance to a baseline rate."""
    rates = _first_category_rates(o, c, i, pr, tr, min_customers, status)
    out = rates.withColumn("vs_baseline", round_half(F.col("repeat_rate_pct") - F.lit(float(baseline))))
    return top_k(out, limit, F.col("repeat_rate_pct").desc(), F.col("category").asc())


def category_loyalty(o, c, i, pr, tr, min_orders: int = 2, status: str = "delivered") -> DataFrame:
    """Per translated category: persons who bought it, how many are repeat persons, rate.

    Untranslated categories are dropped (inner join to the translation).
    """
    freq = person_orders(o, c, status, ()).groupBy(PERSON).agg(F.count(F.lit(1)).alias("total_orders"))
    items = with_category(i.select("order_id", "product_id"), pr, tr, inner=True)
    pairs = (person_orders(o, c, status, ())
             .join(items, "order_id")
             .select(PERSON, "category").distinct())
    n = F.count(F.lit(1))
    rep = F.count_if(F.col("total_orders") >= min_orders)
    return (pairs.join(freq, PERSON).groupBy("category")
            .agg(n.alias("total_customers"), rep.alias("repeat_customers"),
                 pct(rep, n).alias("repeat_rate_percentage"))
            .withColumnRenamed("category", "product_category_name_english")
            .orderBy(F.col("repeat_rate_percentage").desc(), "product_category_name_english"))


# ------------------------------------------------------------------- handoff
def _handoff_per_person(o: DataFrame, c: DataFrame, status: str, fast: int, slow: int) -> DataFrame:
    """Per person: exact microsecond sums of purchase -> carrier handoff times, as decimals: long sums overflow at millions of orders."""
    po = person_orders(o, c, status, ("order_purchase_timestamp", "order_delivered_carrier_date"))
    have = F.col("order_delivered_carrier_date").isNotNull()
    us = micros_between("order_delivered_carrier_date", "order_purchase_timestamp")
    return po.groupBy(PERSON).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.count_if(have).alias("n"),
        F.sum(F.when(have, us.cast("decimal(20,0)"))).alias("s_us"), F.count(F.when(have, us)).alias("c_us"),
        F.count_if(have & (us <= fast * _MICROS_PER_DAY)).alias("__fast"),
        F.count_if(have & (us > slow * _MICROS_PER_DAY)).alias("__slow"),
        F.max(F.when(have, us)).alias("max_us"))


def _handoff_metrics(per: DataFrame, group: str, fast: int, slow: int, worst: bool) -> DataFrame:
    per = per.where(F.col("n") > 0)
    n = F.sum("n")
    day = float(_MICROS_PER_DAY)
    aggs = [n.alias("total_orders"),
            round_half(F.sum("s_us").cast("double") / F.sum("c_us").cast("double") / F.lit(day))
            .alias("avg_handoff_days"),
            pct(F.sum("__fast"), n).alias(f"pct_within_{fast}_days"),
            pct(F.sum("__slow"), n).alias("pct_extreme_delay")]
    if worst:
        aggs.append(round_half(F.max("max_us").cast("double") / F.lit(day), 1).alias("worst_case_handoff"))
    return per.groupBy(group).agg(*aggs)


def handoff_by_segment(o, c, p, status: str = "delivered", fast: int = 3, slow: int = 7,
                       segments: DataFrame | None = None) -> DataFrame:
    """Purchase-to-carrier days per hybrid segment: mean, share within `fast`, share over `slow`, max.

    ``segments`` (person, segment) reuses segments that are already computed.
    """
    if segments is None:
        segments = hybrid_segments(o, c, p, status)
    per = _handoff_per_person(o, c, status, fast, slow).join(segments, PERSON)
    return _handoff_metrics(per, "segment", fast, slow, worst=True).orderBy(F.col("avg_handoff_days").desc(), "segment")


def handoff_one_time_vs_repeat(o, c, status: str = "delivered", fast: int = 3, slow: int = 7,
                               labels=HANDOFF_GROUPS) -> DataFrame:
    """The handoff metrics for repeat vs one-time persons (no max)."""
    per = _handoff_per_person(o, c, status, fast, slow).withColumn(
        "group_type", _repeat_label(F.col("frequency"), labels))
    return _handoff_metrics(per, "group_type", fast, slow, worst=False)


# ------------------------------------------------------------------- freight
def freight_burden(i: DataFrame, o: DataFrame, c: DataFrame, status: str = "delivered",
                   labels=HANDOFF_GROUPS) -> DataFrame:
    """Item price, freight and freight/price per group; the group counts orders of *any* status.

    Items are summed per order, orders per person (all statuses, with the
    status filter applied inside the sums), so no person-key join is needed.
    """
    ratio_col = F.col("freight_value").cast("double") / F.nullif(F.col("price").cast("double"), F.lit(0.0))
    per_order = i.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("i_n"), F.sum("price").alias("i_price"),
        F.sum("freight_value").alias("i_freight"),
        F.sum(ratio_col).alias("i_ratio"), F.count(ratio_col).alias("i_ratio_n"))
    dl = F.col("order_status") == F.lit(status)
    per_person = (person_orders(o, c, None, ("order_status",))
                  .join(per_order, "order_id", "left")
                  .groupBy(PERSON)
                  .agg(F.count(F.lit(1)).alias("total_orders"),
                       *[F.sum(F.when(dl, F.col(x))).alias(x)
                         for x in ("i_n", "i_price", "i_freight", "i_ratio", "i_ratio_n")]))
    typed = per_person.where(F.col("i_n") > 0).withColumn(
        "group_type", _repeat_label(F.col("total_orders"), labels))
    n = F.sum("i_n")
    return typed.groupBy("group_type").agg(
        n.alias("total_orders"),
        avg_of(F.sum("i_price"), n).alias("avg_item_price"),
        avg_of(F.sum("i_freight"), n).alias("avg_freight_value"),
        round_half(F.sum("i_ratio") / F.sum("i_ratio_n") * F.lit(100.0)).alias("freight_as_pct_of_price"))


__all__ = [
    "delivery_by_segment", "delivery_one_time_vs_repeat", "reviews_one_time_vs_repeat",
    "top_categories", "top_category_overlap", "category_repeat_rate_ranked",
    "category_repeat_rate_vs_baseline", "handoff_by_segment", "handoff_one_time_vs_repeat",
    "freight_burden", "category_loyalty", "with_category", "hybrid_segments",
]
