"""Raw (all-text) and cleaned table definitions, with their declared constraints.

The raw layer reads every CSV column as a nullable string so that loading
never fails on a bad value; the typed cast happens in the cleaning step,
where ANSI casts fail fast like the SQL casts they replace.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Raw column names of the nine source extracts, in file order.
RAW_COLUMNS: dict[str, list[str]] = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix",
                  "customer_city", "customer_state"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                    "geolocation_city", "geolocation_state"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id",
                    "shipping_limit_date", "price", "freight_value"],
    "order_payments": ["order_id", "payment_sequential", "payment_type",
                       "payment_installments", "payment_value"],
    "order_reviews": ["review_id", "order_id", "review_score", "review_comment_title",
                      "review_comment_message", "review_creation_date",
                      "review_answer_timestamp"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "products": ["product_id", "product_category_name", "product_name_length",
                 "product_description_length", "product_photos_qty", "product_weight_g",
                 "product_length_cm", "product_height_cm", "product_width_cm"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "product_category_name_translation": ["product_category_name",
                                          "product_category_name_english"],
}


def raw_schema(table: str, corrupt_column: str | None = None) -> StructType:
    """All-string schema of a raw table (plus an optional corrupt-record column)."""
    fields = [StructField(c, StringType(), True) for c in RAW_COLUMNS[table]]
    if corrupt_column:
        fields.append(StructField(corrupt_column, StringType(), True))
    return StructType(fields)


RAW_SCHEMAS = {t: raw_schema(t) for t in RAW_COLUMNS}

# Declared keys and constraints of the cleaned tables.
PRIMARY_KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "geolocation": ["zip_code_prefix"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["order_id", "review_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "product_category_name_translation": ["product_category_name"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]

CONSTRAINTS: dict[str, dict] = {
    "customers": {"not_null": ["customer_id", "customer_unique_id", "zip_code_prefix", "city", "state"],
                  "max_length": [("state", 2)]},
    "geolocation": {"not_null": ["zip_code_prefix", "lat", "lng", "city", "state"],
                    "max_length": [("state", 2)]},
    "order_items": {"not_null": ["order_id", "order_item_id", "product_id", "seller_id",
                                 "shipping_limit_date", "price", "freight_value"],
                    "non_negative": ["price", "freight_value"]},
    "order_payments": {"not_null": ["order_id", "payment_sequential", "payment_type",
                                    "payment_installments", "payment_value"],
                       "non_negative": ["payment_installments", "payment_value"]},
    "order_reviews": {"not_null": ["review_id", "order_id"],
                      "between": [("review_score", 1, 5)]},
    "orders": {"not_null": ["order_id", "customer_id", "order_status"]},
    "products": {"not_null": ["product_id"],
                 "non_negative": ["product_name_length", "product_description_length",
                                  "product_photos_qty", "product_weight_g", "product_length_cm",
                                  "product_height_cm", "product_width_cm"]},
    "sellers": {"not_null": ["seller_id", "zip_code_prefix", "city", "state"],
                "max_length": [("state", 2)]},
    "product_category_name_translation": {
        "not_null": ["product_category_name", "product_category_name_english"]},
}
