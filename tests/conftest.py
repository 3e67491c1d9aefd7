"""Shared fixtures: one local session, and builders for tiny role tables."""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from retentia.session import checkpoint_dir, get_session
    scratch = tempfile.mkdtemp(prefix="retentia-test-")
    os.environ.setdefault("RETENTIA_SCRATCH", scratch)
    s = get_session("local[4]", app_name="retentia-tests", shuffle_partitions=4,
                    extra_conf={"spark.ui.showConsoleProgress": "false",
                                "spark.local.dir": scratch,
                                "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


def ts(s: str | None):
    return None if s is None else dt.datetime.fromisoformat(s)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


ORDERS_SCHEMA = ("order_id string, customer_id string, order_status string, "
                 "order_purchase_timestamp timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
                 "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
CUSTOMERS_SCHEMA = "customer_id string, customer_unique_id string, zip_code_prefix string, city string, state string"
PAYMENTS_SCHEMA = ("order_id string, payment_sequential int, payment_type string, "
                   "payment_installments int, payment_value decimal(10,2)")
ITEMS_SCHEMA = ("order_id string, order_item_id int, product_id string, seller_id string, "
                "shipping_limit_date timestamp_ntz, price decimal(10,2), freight_value decimal(10,2)")
REVIEWS_SCHEMA = "review_id string, order_id string, review_score int, review_comment_message string"
PRODUCTS_SCHEMA = "product_id string, product_category_name string"
TRANSLATION_SCHEMA = "product_category_name string, product_category_name_english string"


def order(oid, person, status="delivered", purchase=None, carrier=None, delivered=None,
          estimated=None, state="SP"):
    """One orders row and its customers row (one transaction id per order)."""
    return ((oid, f"c-{oid}", status, ts(purchase), ts(carrier), ts(delivered), ts(estimated)),
            (f"c-{oid}", person, "01000", "Sao Paulo", state))


def roles(spark, orders, payments=(), items=(), reviews=(), products=(), translation=()):
    o = spark.createDataFrame([r[0] for r in orders], ORDERS_SCHEMA)
    c = spark.createDataFrame([r[1] for r in orders], CUSTOMERS_SCHEMA)
    p = spark.createDataFrame([(a, b, t, n, money(v)) for a, b, t, n, v in payments], PAYMENTS_SCHEMA)
    i = spark.createDataFrame([(a, b, pr, s, ts(d), money(x), money(f)) for a, b, pr, s, d, x, f in items],
                              ITEMS_SCHEMA)
    r = spark.createDataFrame(list(reviews), REVIEWS_SCHEMA)
    pr = spark.createDataFrame(list(products), PRODUCTS_SCHEMA)
    tr = spark.createDataFrame(list(translation), TRANSLATION_SCHEMA)
    return o, c, p, i, r, pr, tr
