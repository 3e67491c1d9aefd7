"""All-text raw extracts derived from the role tables, with seeded faults.

The test data has typed tables only. ``raw_text`` turns every role table into the
text columns of its raw extract: padding, mixed case and blanks everywhere, and
a few broken rows (by key arithmetic) for every kind of declared constraint, so
that the cleaning and constraint operators have something to find:

* customers: missing zip prefixes, states longer than two letters;
* order_items: negative prices, unknown products and sellers, repeated item numbers;
* order_payments: negative installments, unknown orders;
* order_reviews: scores above 5;
* orders: one customer id for two orders, unknown customers;
* products: negative weights; sellers: long states; geolocation: repeated rows.

Every column is one SQL expression that Spark and DuckDB read alike; the oracle
derives the same text from the same expressions and cleans it in its own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_S = "CAST({} AS STRING)"


def _text(*columns: str) -> dict[str, str]:
    return {c: _S.format(c) for c in columns}


#: raw table -> (role table, {raw column: expression over the role's columns})
RAW_TEXT: dict[str, tuple[str, dict[str, str]]] = {
    "customers": ("customers", {
        "customer_id": "CASE WHEN customer_id % 3 = 0 THEN '  ' || CAST(customer_id AS STRING) || ' ' "
                       "ELSE CAST(customer_id AS STRING) END",
        "customer_unique_id": "' ' || CAST(customer_unique_id AS STRING)",
        "customer_zip_code_prefix": "CASE WHEN customer_id % 701 = 3 THEN NULL ELSE CAST(zip_code_prefix AS STRING) || ' ' END",
        "customer_city": "LOWER(city) || '-DO ' || LOWER(state) || '  '",
        "customer_state": "CASE WHEN customer_id % 500 = 7 THEN LOWER(state) ELSE ' ' || LOWER(SUBSTR(state, 1, 2)) END"}),
    "geolocation": ("geolocation_raw", {
        "geolocation_zip_code_prefix": "' ' || CAST(zip_code_prefix AS STRING)",
        "geolocation_lat": "CAST(CAST(lat AS DECIMAL(12,2)) AS STRING)",
        "geolocation_lng": "CAST(CAST(lng AS DECIMAL(12,2)) AS STRING)",
        "geolocation_city": "LOWER(city)",
        "geolocation_state": "LOWER(SUBSTR(state, 1, 2)) || ' '"}),
    "order_items": ("order_items", {
        "order_id": "CASE WHEN order_id % 2 = 0 THEN CAST(order_id AS STRING) || '  ' ELSE CAST(order_id AS STRING) END",
        "order_item_id": "CASE WHEN order_id % 101 = 0 THEN '1' ELSE ' ' || CAST(order_item_id AS STRING) END",
        "product_id": "CASE WHEN order_id % 89 = 4 THEN 'x' || CAST(product_id AS STRING) ELSE CAST(product_id AS STRING) END",
        "seller_id": "CASE WHEN order_id % 97 = 2 THEN '' ELSE CAST(seller_id AS STRING) || ' ' END",
        "shipping_limit_date": "CAST(shipping_limit_date AS STRING) || ' '",
        "price": "CASE WHEN order_id % 97 = 5 THEN '-' || CAST(price AS STRING) ELSE ' ' || CAST(price AS STRING) END",
        **_text("freight_value")}),
    "order_payments": ("order_payments", {
        "order_id": "CASE WHEN order_id % 103 = 1 THEN 'x' || CAST(order_id AS STRING) ELSE CAST(order_id AS STRING) END",
        "payment_sequential": "CAST(payment_sequential AS STRING) || ' '",
        "payment_type": "' ' || payment_type",
        "payment_installments": "CASE WHEN order_id % 107 = 2 THEN '-1' ELSE CAST(payment_installments AS STRING) END",
        **_text("payment_value")}),
    "order_reviews": ("order_reviews", {
        "review_id": "CAST(review_id AS STRING) || ' '",
        "order_id": "' ' || CAST(order_id AS STRING)",
        "review_score": "CASE WHEN review_score IS NULL THEN '' WHEN order_id % 109 = 3 THEN '9' "
                        "ELSE CAST(review_score AS STRING) || ' ' END",
        "review_comment_title": "CASE WHEN order_id % 2 = 0 THEN '  ' ELSE ' re ' || CAST(order_id AS STRING) END",
        "review_comment_message": "review_comment_message || ' '",
        "review_creation_date": "CAST(review_creation_date AS STRING)",
        "review_answer_timestamp": "CASE WHEN order_id % 5 = 0 THEN '' ELSE ' ' || CAST(review_creation_date AS STRING) END"}),
    "orders": ("orders", {
        "order_id": "CASE WHEN order_id % 2 = 1 THEN ' ' || CAST(order_id AS STRING) ELSE CAST(order_id AS STRING) END",
        "customer_id": "CASE WHEN order_id % 211 = 6 THEN 'x' || CAST(customer_id AS STRING) "
                       "WHEN order_id % 50 = 1 THEN CAST(customer_id - 1 AS STRING) ELSE CAST(customer_id AS STRING) END",
        "order_status": "UPPER(order_status) || ' '",
        "order_purchase_timestamp": "CAST(order_purchase_timestamp AS STRING)",
        "order_approved_at": "CASE WHEN order_id % 11 = 0 THEN '' ELSE ' ' || CAST(order_purchase_timestamp AS STRING) END",
        "order_delivered_carrier_date": "COALESCE(CAST(order_delivered_carrier_date AS STRING), '')",
        "order_delivered_customer_date": "COALESCE(CAST(order_delivered_customer_date AS STRING) || ' ', '')",
        "order_estimated_delivery_date": "CAST(order_estimated_delivery_date AS STRING)"}),
    "products": ("products", {
        "product_id": "CAST(product_id AS STRING) || ' '",
        "product_category_name": "COALESCE(' ' || product_category_name, ' ')",
        "product_name_length": "CASE WHEN product_weight_g % 7 = 0 THEN '' ELSE CAST(product_weight_g + 1 AS STRING) END",
        "product_description_length": "CAST(product_weight_g * 10 AS STRING)",
        "product_photos_qty": "CASE WHEN product_weight_g % 7 = 0 THEN ' ' ELSE CAST(product_weight_g % 4 AS STRING) END",
        "product_weight_g": "CASE WHEN product_id % 200 = 3 THEN '-1' ELSE ' ' || CAST(product_weight_g AS STRING) END",
        "product_length_cm": "CAST(product_weight_g AS STRING)",
        "product_height_cm": "CAST(product_weight_g AS STRING)",
        "product_width_cm": "CAST(product_weight_g AS STRING)"}),
    "sellers": ("sellers", {
        "seller_id": "' ' || CAST(seller_id AS STRING)",
        "seller_zip_code_prefix": "CAST(zip_code_prefix AS STRING)",
        "seller_city": "UPPER(city) || ' / ' || LOWER(state)",
        "seller_state": "CASE WHEN seller_id % 10 = 0 THEN LOWER(state) ELSE LOWER(SUBSTR(state, 1, 2)) END"}),
    "product_category_name_translation": ("category_translation", {
        "product_category_name": "' ' || product_category_name",
        "product_category_name_english": "product_category_name_english || ' '"}),
}

#: Geolocation rows that occur a second time.
REPEATED_GEO = "zip_code_prefix % 5 = 0"


def raw_text(role: DataFrame, table: str) -> DataFrame:
    """The raw extract ``table`` as all-text columns, from its role table."""
    if table == "geolocation":
        role = role.unionAll(role.where(REPEATED_GEO))
    return role.selectExpr(*[f"{expr} AS {name}" for name, expr in RAW_TEXT[table][1].items()])
