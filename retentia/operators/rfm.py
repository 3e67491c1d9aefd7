"""RFM segmentation: classic quintiles over all persons, hybrid rules over repeat persons.

Quintiles are global NTILEs computed by ``retentia.operators.ntile``: range
partitioning and offsets, at every size.
Every ordering ends with the person key, so ties are broken the same way on
every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions import avg_of, date_days_between, money, pct, pg_concat_ws
from retentia.operators.common import (
    PERSON, delivered, grand_total, payment_totals, person_orders, snapshot_date, top_k, with_scalar,
)
from retentia.operators.ntile import global_ntiles

# The hybrid segment names and their action priority (1 = act first).
SEGMENTS = {
    "champions": "Champions",
    "engaged": "Active & Engaged",
    "nurturing": "Active - Needs Nurturing",
    "lapsed": "Lapsed - Recovery Target",
    "churned": "Churned",
}
PRIORITY = {"champions": 1, "engaged": 2, "lapsed": 3, "nurturing": 4, "churned": 5}
DIAGONAL = ("5-5-5", "4-4-4", "3-3-3", "2-2-2", "1-1-1")


def rfm_base(o: DataFrame, c: DataFrame, p: DataFrame, status: str = "delivered",
             min_frequency: int = 1) -> DataFrame:
    """Per person: frequency (orders), monetary (payments), recency_days.

    Recency is counted from the snapshot date = latest purchase date over
    orders of *all* statuses, attached as a broadcast one-row relation.
    Payments are collapsed per order before the join, so frequency is a plain
    count of orders.
    """
    per = (person_orders(o, c, status)
           .join(payment_totals(p), "order_id")
           .groupBy(PERSON)
           .agg(F.count(F.lit(1)).alias("frequency"),
                money(F.sum("total_paid")).alias("monetary"),
                F.max("order_purchase_timestamp").cast("date").alias("last_order_date")))
    if min_frequency > 1:
        per = per.where(F.col("frequency") >= min_frequency)
    return (with_scalar(per, snapshot_date(o))
            .select(PERSON, "frequency", "monetary",
                    date_days_between("snapshot_date", "last_order_date").alias("recency_days")))


def _direction(name: str, ascending: bool) -> Column:
    return F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_first()


def score(base: DataFrame, n: int = 5, frequency_ascending: bool = False,
          monetary_ascending: bool = False, recency_ascending: bool = False) -> DataFrame:
    """Add r_score, f_score, m_score = NTILE(n) over each metric (ties by person key).

    ``*_ascending=False`` orders the metric DESC, so bucket 1 holds the largest
    values; the reference's classic scoring does this for all three metrics.
    """
    return global_ntiles(base, n, {
        "r_score": [_direction("recency_days", recency_ascending), F.col(PERSON).asc()],
        "f_score": [_direction("frequency", frequency_ascending), F.col(PERSON).asc()],
        "m_score": [_direction("monetary", monetary_ascending), F.col(PERSON).asc()],
    })


def rfm_scores(o: DataFrame, c: DataFrame, p: DataFrame, n: int = 5,
               higher_is_better: bool = False, status: str = "delivered") -> DataFrame:
    """Classic RFM over all persons, with the 'r-f-m' code in ``rfm_segment``.

    ``higher_is_better=False`` reproduces the reference (f and m ordered DESC,
    so 5 goes to the *lowest* frequency/spend); ``True`` gives 5 to the highest.
    """
    scored = score(rfm_base(o, c, p, status), n,
                   frequency_ascending=higher_is_better, monetary_ascending=higher_is_better)
    return scored.withColumn("rfm_segment", pg_concat_ws("-", "r_score", "f_score", "m_score"))


def rfm_classic(o: DataFrame, c: DataFrame, p: DataFrame, n: int = 5, limit: int | None = 50,
                higher_is_better: bool = False, status: str = "delivered") -> DataFrame:
    """Top persons by r, f, m score and spend (the reference's first RFM report)."""
    return classic_top(rfm_scores(o, c, p, n, higher_is_better, status), limit)


def classic_top(scores: DataFrame, limit: int | None = 50) -> DataFrame:
    """The top persons of a table of ``rfm_scores``."""
    scored = scores.select(
        PERSON, "r_score", "f_score", "m_score", "rfm_segment", "frequency", "monetary", "recency_days")
    return top_k(scored, limit, F.col("r_score").desc(), F.col("f_score").desc(),
                 F.col("m_score").desc(), F.col("monetary").desc(), F.col(PERSON).asc())


def rfm_diagonal(rfm: DataFrame, codes=DIAGONAL) -> DataFrame:
    """Size and profile of selected RFM codes; the share is of the selected codes only."""
    per = (rfm.where(F.col("rfm_segment").isin(*codes))
           .groupBy("rfm_segment")
           .agg(F.count(F.lit(1)).alias("customer_count"),
                avg_of(F.sum("frequency"), F.count("frequency")).alias("avg_frequency"),
                avg_of(F.sum("monetary"), F.count("monetary")).alias("avg_monetary"),
                avg_of(F.sum("recency_days"), F.count("recency_days"), 1).alias("avg_recency"),
                F.min("frequency").alias("min_frequency"),
                F.max("frequency").alias("max_frequency")))
    return (per.withColumn("pct_of_total", pct("customer_count", grand_total("customer_count")))
            .orderBy(F.col("rfm_segment").desc()))


def hybrid_segment(vip_frequency: int = 5, labels: dict | None = None) -> Column:
    """Rule-based segment from raw frequency and the three scores."""
    lab = {**SEGMENTS, **(labels or {})}
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (F.when((F.col("frequency") >= vip_frequency) | ((r >= 4) & (f >= 4) & (m >= 4)),
                   lab["champions"])
            .when((r >= 4) & (m >= 3), lab["engaged"])
            .when(r >= 3, lab["nurturing"])
            .when((r == 2) & ((f >= 3) | (m >= 3)), lab["lapsed"])
            .otherwise(lab["churned"]))


def rfm_hybrid(o: DataFrame, c: DataFrame, p: DataFrame, vip_frequency: int = 5,
               labels: dict | None = None, n: int = 5, status: str = "delivered") -> DataFrame:
    """Repeat persons only; f and m scored ascending (5 = most); five rule-based segments."""
    return hybrid_order(hybrid_table(o, c, p, vip_frequency, labels, n, status))


def hybrid_order(table: DataFrame) -> DataFrame:
    """The rows of ``hybrid_table`` in the order of the report."""
    return table.orderBy("action_priority", F.col("monetary").desc_nulls_first(), PERSON)


def hybrid_table(o: DataFrame, c: DataFrame, p: DataFrame, vip_frequency: int = 5,
                 labels: dict | None = None, n: int = 5, status: str = "delivered") -> DataFrame:
    """The rows of ``rfm_hybrid``, unordered."""
    lab = {**SEGMENTS, **(labels or {})}
    base = rfm_base(o, c, p, status, min_frequency=2)
    scored = score(base, n, frequency_ascending=True, monetary_ascending=True)
    seg = scored.withColumn("segment", hybrid_segment(vip_frequency, lab))
    priority = F.lit(PRIORITY["churned"])
    for key in ("lapsed", "nurturing", "engaged", "champions"):
        priority = F.when(F.col("segment") == lab[key], PRIORITY[key]).otherwise(priority)
    return seg.select(PERSON, "recency_days", "frequency", "monetary", "r_score", "f_score",
                      "m_score", pg_concat_ws("-", "r_score", "f_score", "m_score").alias("rfm_code"),
                      "segment", priority.alias("action_priority"))


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """Per segment: persons, share, average value and recency, revenue and its share."""
    per = rfm.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        avg_of(F.sum("monetary"), F.count("monetary")).alias("avg_value"),
        avg_of(F.sum("recency_days"), F.count("recency_days"), 1).alias("avg_recency"),
        money(F.sum("monetary")).alias("total_revenue"))
    return per.select("segment", "customers",
                      pct("customers", grand_total("customers")).alias("pct"),
                      "avg_value", "avg_recency", "total_revenue",
                      pct("total_revenue", grand_total("total_revenue")).alias("revenue_pct"))
