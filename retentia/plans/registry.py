"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables of ``sf_dir`` through the role adapter
and runs one library operator with the parameters used for the test data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from retentia.operators import churn as ch
from retentia.operators import clean as cl
from retentia.operators import quality as dq
from retentia.operators import revenue as rv
from retentia.operators import rfm
from retentia.operators import rootcause as rc
from retentia.operators.keys import KeyAudit
from retentia.session import checkpoint_dir
from retentia.sources import warehouse as wh
from retentia.sources.csvsplit import bad_records, parsed_records, read_multiline
from retentia.sources.ingest import read_raw
from retentia.sources.roles import Roles, roles_for
from retentia.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS

# Order looked up by the point-lookup style queries (present at every scale factor).
LOOKUP_ORDER_ID = 7

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}
_ON_ROLES: dict[str, Callable[[Roles], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        _REG[name] = lambda spark, sf_dir: fn(roles_for(spark, sf_dir))
        _ON_ROLES[name] = fn
        return fn
    return deco


def run_on_roles(name: str, roles: Roles) -> DataFrame:
    """Run a registered query on a given set of role tables."""
    return _ON_ROLES[name](roles)


# ---------------------------------------------------------------- revenue (B)
@register("order_total_vs_paid")
def _b1(r: Roles):
    return rv.order_total_vs_paid(r.order_items, r.order_payments, LOOKUP_ORDER_ID)


@register("naive_overview")
def _b2(r: Roles):
    return rv.naive_overview(r.orders, r.order_payments)


@register("naive_overview_unique")
def _b3(r: Roles):
    return rv.naive_overview(r.orders, r.order_payments, customers=r.customers)


@register("revenue_overview")
def _b4(r: Roles):
    return rv.revenue_overview(r.orders, r.customers, r.order_items, r.order_payments)


@register("delivered_counts")
def _b5(r: Roles):
    return rv.delivered_counts(r.orders)


@register("customers_multi_orders_txn")
def _b6(r: Roles):
    return rv.customers_multi_orders(r.orders, key="customer_id", limit=20)


@register("orders_per_txn_customer")
def _b7(r: Roles):
    return rv.orders_per_customer(r.orders)


@register("multi_order_customers")
def _b8(r: Roles):
    return rv.multi_order_customers(r.orders, r.customers, limit=10)


@register("multi_order_customers_array")
def _b8_array(r: Roles):
    out = rv.multi_order_pages(r.orders, r.customers, limit=10)
    return out.withColumn("order_ids", F.array_join(F.col("order_ids").cast("array<string>"), ","))


@register("executive_summary")
def _b9(r: Roles):
    return rv.executive_summary(r.orders, r.customers, r.order_payments)


@register("monthly_trends")
def _b10(r: Roles):
    return rv.monthly_trends(r.orders, r.order_payments)


@register("category_gmv")
def _b11(r: Roles):
    return rv.category_gmv(r.order_items, r.products, r.category_translation, limit=20)


@register("repeat_customer_analysis")
def _b12(r: Roles):
    return rv.repeat_customer_analysis(r.orders, r.customers, r.order_payments)


@register("state_pareto")
def _b13(r: Roles):
    return rv.state_pareto(r.orders, r.customers, r.order_payments)


# -------------------------------------------------------------------- rfm (R)
def _classic(r: Roles) -> DataFrame:
    """Classic scores of all persons: ranked once per role layer, read by R1 and R2."""
    return r.stored("rfm_classic_scores", lambda: rfm.rfm_scores(r.orders, r.customers, r.order_payments))


def _hybrid(r: Roles) -> DataFrame:
    """Hybrid segments of repeat persons: ranked once per role layer, read by R3, R4, T1 and T7."""
    return r.stored("rfm_hybrid_segments", lambda: rfm.hybrid_table(r.orders, r.customers, r.order_payments))


@register("rfm_classic")
def _r1(r: Roles):
    return rfm.classic_top(_classic(r), limit=50)


@register("rfm_diagonal")
def _r2(r: Roles):
    return rfm.rfm_diagonal(_classic(r))


@register("rfm_hybrid")
def _r3(r: Roles):
    return rfm.hybrid_order(_hybrid(r))


@register("rfm_segment_summary")
def _r4(r: Roles):
    return rfm.rfm_segment_summary(_hybrid(r))


# -------------------------------------------------------------- root cause (T)
# The test data has 39 to 75 persons per first-purchase category.
MIN_CATEGORY_PERSONS = 50


@register("delivery_by_segment")
def _t1(r: Roles):
    return rc.delivery_by_segment(r.orders, r.customers, r.order_payments,
                                  segments=rc.relabelled(_hybrid(r)))


@register("delivery_one_time_vs_repeat")
def _t2(r: Roles):
    return rc.delivery_one_time_vs_repeat(r.orders, r.customers)


@register("reviews_one_time_vs_repeat")
def _t3(r: Roles):
    return rc.reviews_one_time_vs_repeat(r.orders, r.customers, r.order_reviews)


@register("top_categories_side_by_side")
def _t4(r: Roles):
    return rc.top_categories(r.orders, r.customers, r.order_items, r.products,
                             r.category_translation, k=5)


@register("category_repeat_rate_ranked")
def _t5(r: Roles):
    return rc.category_repeat_rate_ranked(r.orders, r.customers, r.order_items, r.products,
                                          r.category_translation,
                                          min_customers=MIN_CATEGORY_PERSONS, limit=20)


@register("category_repeat_rate_vs_baseline")
def _t6(r: Roles):
    return rc.category_repeat_rate_vs_baseline(r.orders, r.customers, r.order_items, r.products,
                                               r.category_translation,
                                               min_customers=MIN_CATEGORY_PERSONS, baseline=3.0)


@register("handoff_by_segment")
def _t7(r: Roles):
    return rc.handoff_by_segment(r.orders, r.customers, r.order_payments,
                                 segments=rc.relabelled(_hybrid(r)))


@register("handoff_one_time_vs_repeat")
def _t8(r: Roles):
    return rc.handoff_one_time_vs_repeat(r.orders, r.customers)


@register("freight_burden")
def _t9(r: Roles):
    return rc.freight_burden(r.order_items, r.orders, r.customers)


@register("category_loyalty")
def _t10(r: Roles):
    return rc.category_loyalty(r.orders, r.customers, r.order_items, r.products,
                               r.category_translation)


# ------------------------------------------------------------------- churn (C)
@register("second_purchase_stats")
def _c1(r: Roles):
    return ch.second_purchase_stats(r.orders, r.customers)


@register("second_purchase_stats_excl_same_day")
def _c2(r: Roles):
    return ch.second_purchase_stats(r.orders, r.customers, min_gap=1)


@register("purchase_window_distribution")
def _c3(r: Roles):
    return ch.purchase_windows(r.orders, r.customers, edges=(7, 30, 90, 180))


@register("churn_status")
def _c4(r: Roles):
    return ch.churn_status(r.orders, r.customers, active=75, at_risk=150)


# ---------------------------------------------------------- published only (X)
@register("purchase_funnel")
def _x1(r: Roles):
    return ch.purchase_funnel(r.orders, r.customers, r.order_payments, steps=4)


@register("repeat_rate_opportunity")
def _x2(r: Roles):
    return ch.repeat_rate_opportunity(r.orders, r.customers, r.order_payments, factor=2.0)


@register("same_day_repeat_share")
def _x3(r: Roles):
    return ch.same_day_repeat_share(r.orders, r.customers)


@register("top_category_overlap")
def _x4(r: Roles):
    return rc.top_category_overlap(r.orders, r.customers, r.order_items, r.products,
                                   r.category_translation, k=5)


# ------------------------------------------------------- ingest checks (E)
def _role_tables(r: Roles) -> dict:
    return {"customers": r.customers, "orders": r.orders, "order_items": r.order_items,
            "order_payments": r.order_payments, "order_reviews": r.order_reviews,
            "products": r.products, "product_category_name_translation": r.category_translation,
            "sellers": r.sellers, "geolocation_raw": r.geolocation_raw}


@register("row_counts")
def _e1(r: Roles):
    return dq.row_counts(_role_tables(r))


@register("duplicate_rows")
def _e2(r: Roles):
    return dq.duplicate_rows(r.geolocation_raw, ["zip_code_prefix", "lat", "lng"])


def geolocation(r: Roles):
    return cl.clean_geolocation(r.geolocation_raw, "zip_code_prefix", "lat", "lng", "city", "state")


@register("geo_collapse")
def _e3(r: Roles):
    # floating means depend on summation order in the last bits: compare at 6 digits
    g = geolocation(r)
    return g.select("zip_code_prefix", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
                    "city", "state")


@register("dup_keys")
def _e4(r: Roles):
    return dq.dup_keys(r.order_reviews, ["review_id"])


#: The other key candidates whose repeats the reports ask for: key -> (role table, columns).
DUP_KEYS = {
    "dup_keys_items": ("order_items", ["order_id", "order_item_id"]),
    "dup_keys_payments": ("order_payments", ["order_id", "payment_sequential"]),
    "dup_keys_customers": ("customers", ["customer_id"]),
    "dup_keys_persons": ("customers", ["customer_unique_id"]),
    "dup_keys_review_orders": ("order_reviews", ["review_id", "order_id"]),
}
for _key, (_table, _cols) in DUP_KEYS.items():
    register(_key)(lambda r, _table=_table, _cols=_cols: dq.dup_keys(getattr(r, _table), _cols))


@register("dup_keys_payment_orders")
def _e4b(r: Roles):
    return dq.dup_keys(r.order_payments, ["order_id"])


@register("point_lookup")
def _e5(r: Roles):
    return dq.lookup(r.order_items, "order_id", LOOKUP_ORDER_ID)


# --------------------------------------------------------- data quality (D)
@register("value_range")
def _d1(r: Roles):
    return dq.value_range(r.order_items, "price")


@register("null_audit")
def _d2(r: Roles):
    return dq.null_audit({
        "customers": (r.customers, ["customer_id", "customer_unique_id"]),
        "orders": (r.orders, ["order_id", "customer_id", "order_purchase_timestamp"]),
        "order_items": (r.order_items, ["order_id", "order_item_id", "product_id", "seller_id",
                                        "price", "freight_value"]),
        "order_payments": (r.order_payments, ["order_id", "payment_sequential", "payment_value"]),
        "order_reviews": (r.order_reviews, ["review_id", "order_id", "review_score"]),
        "products": (r.products, ["product_id", "product_category_name"]),
        "sellers": (r.sellers, ["seller_id"]),
        "geolocation": (geolocation(r), ["zip_code_prefix", "lat", "lng"]),
    })


@register("id_cardinality")
def _d3(r: Roles):
    return dq.id_cardinality(r.customers)


@register("shared_reviews")
def _d4(r: Roles):
    return dq.shared_reviews(r.order_reviews, limit=20)


@register("composite_key_check")
def _d5(r: Roles):
    return dq.composite_key_check(r.order_reviews, ["review_id", "order_id"])


@register("orphan_audit")
def _d6(r: Roles):
    return dq.orphan_audit([
        ("orders.customer_id", r.orders, "customer_id", r.customers, "customer_id"),
        ("order_items.order_id", r.order_items, "order_id", r.orders, "order_id"),
        ("order_items.product_id", r.order_items, "product_id", r.products, "product_id"),
        ("order_items.seller_id", r.order_items, "seller_id", r.sellers, "seller_id"),
        ("order_payments.order_id", r.order_payments, "order_id", r.orders, "order_id"),
        ("order_reviews.order_id", r.order_reviews, "order_id", r.orders, "order_id"),
    ])


@register("ghost_orders")
def _d7(r: Roles):
    return dq.ghost_orders(r.orders, r.order_items, "delivered")


@register("payment_reconciliation")
def _d8(r: Roles):
    return dq.payment_reconciliation(r.order_items, r.order_payments, tolerance=1.00)


@register("payment_reconciliation_voucher")
def _d9(r: Roles):
    return dq.payment_reconciliation_voucher(r.order_items, r.order_payments, tolerance=1.00)


@register("discrepancy_by_installments")
def _d10(r: Roles):
    return dq.discrepancy_by_installments(r.order_items, r.order_payments, tolerance=1.00)


@register("orders_without_items_by_status")
def _d11(r: Roles):
    return dq.orders_without_items_by_status(r.orders, r.order_items)


@register("multi_method_payments")
def _d12(r: Roles):
    return dq.multi_method_payments(r.order_payments)


# The test orders run from 1995-01-01 to 2001-08-01; "now" is fixed for determinism.
IMPOSSIBLE_LOWER, IMPOSSIBLE_AS_OF = "1995-01-01", "2001-07-01"


@register("impossible_dates")
def _d13(r: Roles):
    return dq.impossible_dates(r.orders, lower=IMPOSSIBLE_LOWER, as_of=IMPOSSIBLE_AS_OF)


# ------------------------------------------------- raw extracts, cleaning, constraints
for _raw in cl.CLEANERS:
    if _raw != "geolocation":  # collapsed: see geo_collapse
        register(f"clean_{_raw}")(lambda r, _raw=_raw: cl.CLEANERS[_raw](r.raw_table(_raw)))


def _loaded(r: Roles) -> dict[str, DataFrame]:
    """Cleaned tables of the raw extracts, faults included."""
    return {t: cleaner(r.raw_table(t)) for t, cleaner in cl.CLEANERS.items()}


@register("constraint_audit")
def _cst(r: Roles):
    return wh.constraint_report(_loaded(r))


@register("raw_cleaned_counts")
def _counts(r: Roles):
    return dq.row_count_check({t: (r.raw_table(t), df) for t, df in _loaded(r).items()})


@register("duplicate_rows_raw")
def _dup_raw(r: Roles):
    return dq.duplicate_rows(r.raw_table("geolocation"), ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"])


@register("dup_keys_items_raw")
def _dup_items_raw(r: Roles):
    return dq.dup_keys(_loaded(r)["order_items"], ["order_id", "order_item_id"])


@register("composite_key_check_raw")
def _ckc_raw(r: Roles):
    return dq.composite_key_check(_loaded(r)["order_items"], ["order_id", "order_item_id"])


@register("orphan_audit_raw")
def _orphans_raw(r: Roles):
    return KeyAudit(_loaded(r), {}, FOREIGN_KEYS).orphans()


@register("key_audit_raw")
def _keys_raw(r: Roles):
    return KeyAudit(_loaded(r), PRIMARY_KEYS, []).keys()


# ------------------------------------------------------ extracts written and loaded
def _extract(r: Roles, *frames: DataFrame) -> str:
    """A folder of CSV files with headers, in the shared checkpoint folder."""
    path = f"{checkpoint_dir(r.spark).rstrip('/')}/extract-{uuid.uuid4().hex}"
    for df in frames:
        df.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return path


@register("load_order_items_csv")
def _load_items(r: Roles):
    return cl.clean_order_items(read_raw(r.spark, "order_items", _extract(r, r.raw_table("order_items"))))


@register("load_order_reviews_csv")
def _load_reviews(r: Roles):
    # messages of three lines, with quotes and separators
    raw = r.raw_table("order_reviews").withColumn("review_comment_message", F.expr(
        "review_comment_message || '\\n\"quoted\", part ' || review_id || '\\nend'"))
    loaded = cl.clean_order_reviews(read_multiline(r.spark, "order_reviews", _extract(r, raw)))
    return loaded.select("order_id", "review_id", "review_score", "review_comment_message")


@register("bad_records_csv")
def _bad_records(r: Roles):
    # some records have a field too many, some one too few
    raw = r.raw_table("order_items")
    number = F.trim("order_id").cast("long")
    wrong = number % 13 == 5
    few = raw.where(wrong & (number % 2 == 0)).drop(raw.columns[-1])
    path = _extract(r, raw.where(~wrong), raw.where(wrong & (number % 2 == 1)).withColumn("more", F.lit("x")), few)
    found = bad_records(parsed_records(r.spark, "order_items", path))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@register("customers_multi_orders_txn_raw")
def _multi_raw(r: Roles):
    return rv.customers_multi_orders(_loaded(r)["orders"], "customer_id", limit=20)


def queries() -> dict[str, Query]:
    return dict(_REG)
