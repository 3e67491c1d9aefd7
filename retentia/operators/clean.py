"""Raw (all-text) -> cleaned (typed) tables.

Each function is a projection (and, for geolocation, one aggregation) that
Catalyst fuses into the scan's code-generated stage. Casts are ANSI: a value
that does not parse fails the job, as the typed load it replaces did. Blank
strings become NULL only in nullable columns; a required column keeps the
blank so that the cast (or the NOT NULL check) rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions import nullif_blank, pg_initcap


def _t(c: str):
    return F.trim(F.col(c))


def _ts(c: str, nullable: bool = True):
    src = F.col(c) if not nullable else F.nullif(F.col(c), F.lit(""))
    return F.trim(src).cast("timestamp_ntz")


def clean_customers(raw: DataFrame) -> DataFrame:
    return raw.select(_t("customer_id").alias("customer_id"),
                      _t("customer_unique_id").alias("customer_unique_id"),
                      _t("customer_zip_code_prefix").alias("zip_code_prefix"),
                      pg_initcap(_t("customer_city")).alias("city"),
                      F.upper(_t("customer_state")).alias("state"))


def clean_geolocation(raw: DataFrame, zip_col: str = "geolocation_zip_code_prefix",
                      lat: str = "geolocation_lat", lng: str = "geolocation_lng",
                      city: str = "geolocation_city", state: str = "geolocation_state") -> DataFrame:
    """Collapse many rows per zip prefix to one: mean coordinates, max city/state.

    A hash aggregate with map-side partial aggregation: a zip prefix with a
    huge number of rows is reduced inside each map task before the shuffle.
    """
    return (raw.groupBy(F.trim(F.col(zip_col).cast("string")).alias("zip_code_prefix"))
            .agg(F.avg(F.col(lat).cast("double")).alias("lat"),
                 F.avg(F.col(lng).cast("double")).alias("lng"),
                 F.max(pg_initcap(F.trim(F.col(city)))).alias("city"),
                 F.max(F.upper(F.trim(F.col(state)))).alias("state")))


def clean_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(_t("order_id").alias("order_id"),
                      _t("order_item_id").cast("int").alias("order_item_id"),
                      _t("product_id").alias("product_id"),
                      _t("seller_id").alias("seller_id"),
                      _ts("shipping_limit_date", nullable=False).alias("shipping_limit_date"),
                      _t("price").cast("decimal(10,2)").alias("price"),
                      _t("freight_value").cast("decimal(10,2)").alias("freight_value"))


def clean_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(_t("order_id").alias("order_id"),
                      _t("payment_sequential").cast("int").alias("payment_sequential"),
                      _t("payment_type").alias("payment_type"),
                      _t("payment_installments").cast("int").alias("payment_installments"),
                      _t("payment_value").cast("decimal(10,2)").alias("payment_value"))


def clean_order_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(_t("review_id").alias("review_id"),
                      _t("order_id").alias("order_id"),
                      nullif_blank("review_score").cast("int").alias("review_score"),
                      nullif_blank("review_comment_title").alias("review_comment_title"),
                      nullif_blank("review_comment_message").alias("review_comment_message"),
                      _ts("review_creation_date").alias("review_creation_date"),
                      _ts("review_answer_timestamp").alias("review_answer_timestamp"))


_PRODUCT_INTS = ["product_name_length", "product_description_length", "product_photos_qty",
                 "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]


def clean_products(raw: DataFrame) -> DataFrame:
    return raw.select(_t("product_id").alias("product_id"),
                      nullif_blank("product_category_name").alias("product_category_name"),
                      *[nullif_blank(c).cast("int").alias(c) for c in _PRODUCT_INTS])


_ORDER_TS = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
             "order_delivered_customer_date", "order_estimated_delivery_date"]


def clean_orders(raw: DataFrame) -> DataFrame:
    return raw.select(_t("order_id").alias("order_id"),
                      _t("customer_id").alias("customer_id"),
                      F.lower(_t("order_status")).alias("order_status"),
                      *[_ts(c).alias(c) for c in _ORDER_TS])


def clean_category_translation(raw: DataFrame) -> DataFrame:
    return raw.select(_t("product_category_name").alias("product_category_name"),
                      _t("product_category_name_english").alias("product_category_name_english"))


def clean_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(_t("seller_id").alias("seller_id"),
                      _t("seller_zip_code_prefix").alias("zip_code_prefix"),
                      pg_initcap(_t("seller_city")).alias("city"),
                      F.upper(_t("seller_state")).alias("state"))


CLEANERS = {
    "customers": clean_customers,
    "geolocation": clean_geolocation,
    "order_items": clean_order_items,
    "order_payments": clean_order_payments,
    "order_reviews": clean_order_reviews,
    "products": clean_products,
    "orders": clean_orders,
    "product_category_name_translation": clean_category_translation,
    "sellers": clean_sellers,
}
