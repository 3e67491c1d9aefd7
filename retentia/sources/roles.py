"""Role adapter: driver parquet tables -> the retail role tables.

The operators are written against role tables (orders, customers,
order_items, order_payments, order_reviews, products,
product_category_name_translation, sellers, geolocation). The test data is a
TPC-H-like star schema; this module derives role tables from it with plain
DataFrame code. The same definitions are given as SQL for the oracle in
``retentia.plans.oracle.ROLES_SQL``; both must stay in step.

Everything here is lazy: nothing is read until an operator's result is
executed, so Catalyst prunes the columns and pushes filters into the scans.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.sources.rawtext import RAW_TEXT, raw_text
from retentia.sources.versions import VersionedFolder

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")
ROLE_TABLES = ("customers", "orders", "order_items", "order_payments", "order_reviews",
               "products", "category_translation", "sellers", "geolocation_raw")
CONF_MATERIALIZE = "retentia.roles.materialize"
CONF_BUCKETS = "retentia.roles.orderBuckets"
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")
_LAYERS: dict[tuple[str, str], "MaterializedRoles"] = {}
_LOCK = threading.Lock()


class Roles:
    """Lazily built role DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw_table(self, name: str) -> DataFrame:
        """The all-text raw extract ``name``."""
        return raw_text(getattr(self, RAW_TEXT[name][0]), name)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from the roles; a materialized layer keeps it for later queries."""
        return build()

    # -- helpers -------------------------------------------------------------
    def _orders(self, *columns: str) -> DataFrame:
        return self.table("orders").select("o_orderkey", *columns)

    def _lines(self, *columns: str) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", *columns)

    @cached_property
    def _geo_dims(self) -> DataFrame:
        """nation joined to region: 25 rows, broadcast by size."""
        return (self.table("nation")
                .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("n_nationkey", "n_name", "r_name"))

    @cached_property
    def _ship(self) -> DataFrame:
        """First and last ship date per order, counting lines shipped a day or more after the order."""
        li = self._lines("l_shipdate")
        od = self._orders("o_orderdate")
        return (li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
                .where(F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("INTERVAL '1' DAY"))
                .groupBy("l_orderkey")
                .agg(F.min("l_shipdate").alias("d1"), F.max("l_shipdate").alias("d2")))

    # -- role tables ---------------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        """One transaction id per order (= order key), one person per custkey."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
                .join(self._geo_dims, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("o_orderkey").alias("customer_id"),
                        F.col("o_custkey").alias("customer_unique_id"),
                        F.col("c_nationkey").alias("zip_code_prefix"),
                        F.col("r_name").alias("city"),
                        F.col("n_name").alias("state")))

    @cached_property
    def orders(self) -> DataFrame:
        o = self._orders("o_orderstatus", "o_orderdate")
        status = (F.when(F.col("o_orderstatus") == "F", "delivered")
                  .when(F.col("o_orderstatus") == "O", "shipped")
                  .otherwise("canceled"))
        seconds = F.expr("INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400)")
        return (o.join(self._ship, F.col("l_orderkey") == F.col("o_orderkey"), "left")
                .select(F.col("o_orderkey").alias("order_id"),
                        F.col("o_orderkey").alias("customer_id"),
                        status.alias("order_status"),
                        (F.col("o_orderdate") + seconds).alias("order_purchase_timestamp"),
                        F.col("d1").alias("order_delivered_carrier_date"),
                        F.col("d2").alias("order_delivered_customer_date"),
                        (F.col("o_orderdate") + F.expr("INTERVAL '600' DAY"))
                        .alias("order_estimated_delivery_date")))

    @cached_property
    def order_items(self) -> DataFrame:
        li = self._lines("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.row_number().over(w).alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"))

    @cached_property
    def order_payments(self) -> DataFrame:
        li = self._lines("l_returnflag", "l_linenumber", "l_extendedprice", "l_quantity")
        fee = F.when(F.col("l_returnflag") == "A",
                     F.lit(0.50).cast("decimal(10,2)") * F.col("l_linenumber")).otherwise(F.lit(0))
        line_value = (F.col("l_extendedprice").cast("decimal(10,2)")
                      + F.col("l_quantity").cast("decimal(10,2)") + fee)
        grouped = li.groupBy("l_orderkey", "l_returnflag").agg(
            F.max("l_linenumber").alias("payment_installments"),
            F.sum(line_value).cast("decimal(18,2)").alias("payment_value"))
        w = Window.partitionBy("l_orderkey").orderBy("l_returnflag")
        ptype = (F.when(F.col("l_returnflag") == "A", "credit_card")
                 .when(F.col("l_returnflag") == "R", "voucher")
                 .otherwise("boleto"))
        return grouped.select(
            F.col("l_orderkey").alias("order_id"),
            F.row_number().over(w).alias("payment_sequential"),
            ptype.alias("payment_type"),
            "payment_installments", "payment_value")

    @cached_property
    def order_reviews(self) -> DataFrame:
        ev = self.table("events")
        n = self.table("orders").agg(F.count(F.lit(1)).alias("_n"))
        review_id = F.when(F.col("event_id") % 10 == 0, F.col("event_id") + 1).otherwise(F.col("event_id"))
        score = F.when(F.col("event_type") == "error", F.lit(None).cast("int")).otherwise(
            F.lit(1) + F.floor("value").cast("int") % 5)
        # one-row relation: broadcast has a proven size bound
        return ev.crossJoin(F.broadcast(n)).select(
            review_id.alias("review_id"),
            (F.col("event_id") % F.col("_n")).alias("order_id"),
            score.alias("review_score"),
            F.col("props").alias("review_comment_message"),
            F.col("ts").alias("review_creation_date"))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") % 17 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("p_brand")).alias("product_category_name"),
            F.col("p_size").alias("product_weight_g"))

    @cached_property
    def category_translation(self) -> DataFrame:
        return (self.table("part")
                .where(~F.col("p_brand").isin("Brand#5", "Brand#10"))
                .select(F.col("p_brand").alias("product_category_name"),
                        F.lower(F.regexp_replace("p_brand", "#", "_"))
                        .alias("product_category_name_english"))
                .distinct())

    @cached_property
    def sellers(self) -> DataFrame:
        return (self.table("supplier")
                .join(self._geo_dims, F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("seller_id"),
                        F.col("s_nationkey").alias("zip_code_prefix"),
                        F.col("r_name").alias("city"),
                        F.col("n_name").alias("state")))

    @cached_property
    def geolocation_raw(self) -> DataFrame:
        """Uncollapsed geolocation rows: many per zip prefix."""
        return (self.table("customer")
                .join(self._geo_dims, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_nationkey").alias("zip_code_prefix"),
                        F.col("c_acctbal").alias("lat"),
                        (-F.col("c_acctbal")).alias("lng"),
                        F.col("c_name").alias("city"),
                        F.col("n_name").alias("state")))


class SpreadRoles(Roles):
    """Role tables whose order and line rows are shuffled by order key once, before anything else.

    Joins, aggregates and windows per order then need no other shuffle, the written
    tables none either, and no task holds more than a bucket. Without it a task's share
    follows the shuffle partitions or the input splits, and large tables spill.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, buckets: int):
        super().__init__(spark, sf_dir)
        self.buckets = buckets

    def _orders(self, *columns: str) -> DataFrame:
        return super()._orders(*columns).repartition(self.buckets, "o_orderkey")

    def _lines(self, *columns: str) -> DataFrame:
        return super()._lines(*columns).repartition(self.buckets, "l_orderkey")


class MaterializedRoles(Roles):
    """Role tables written to the shared checkpoint folder when first read, and read back from then on.

    The equivalent of building the cleaned schema once and querying it many
    times: the derivations (joins, windows, aggregations over the driver
    tables) run in one job per table instead of inside every query, and only for the
    tables that a query reads. The orders table also stores each order's person key,
    resolved once here.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, tag: str):
        super().__init__(spark, sf_dir)
        self.root, self.tag = root, tag
        self._kept: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._kept:
                self._kept[name] = make()
            return self._kept[name]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        def make() -> DataFrame:
            path = f"{self.root}/{name}"
            build().write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

        return self._once(name, make)

    @cached_property
    def _source(self) -> Roles:
        plain = Roles(self.spark, self.sf_dir)
        buckets = bucket_count(self.spark, plain.order_items)
        return SpreadRoles(self.spark, self.sf_dir, buckets) if buckets else plain

    def _role(self, name: str) -> DataFrame:
        src = self._source
        df = getattr(src, name)
        if name == "orders":
            # resolve the person of each order once (customers.customer_id is the primary key)
            df = df.join(src.customers.select("customer_id", "customer_unique_id"), "customer_id", "left") \
                .select(*df.columns, "customer_unique_id")
        if name not in ORDER_KEYED or not isinstance(src, SpreadRoles):
            return self.stored(name, lambda: df)

        def make() -> DataFrame:
            # co-located on order_id: per-order aggregates and order joins need no exchange;
            # repartitioning on the bucket key gives one file per bucket, and is no shuffle where rows lie so already
            table = f"retentia_roles_{self.tag}_{name}"
            (df.repartition(src.buckets, "order_id").write.mode("overwrite")
             .bucketBy(src.buckets, "order_id").sortBy("order_id")
             .option("path", f"{self.root}/{name}")
             .saveAsTable(table))
            return self.spark.table(table)

        return self._once(name, make)

    @classmethod
    def build(cls, spark: SparkSession, sf_dir: str) -> "MaterializedRoles":
        from retentia.session import checkpoint_dir
        app = spark.sparkContext.applicationId
        tag = hashlib.sha1(f"{sf_dir.rstrip('/')}|{app}".encode()).hexdigest()[:12]
        return cls(spark, sf_dir, f"{checkpoint_dir(spark).rstrip('/')}/retentia-roles-{tag}", tag)


for _name in ROLE_TABLES:
    setattr(MaterializedRoles, _name, property(lambda self, _name=_name: self._role(_name)))


#: Bytes of the largest order-keyed table that one bucket may hold, by the size of its Parquet files.
#: Rows in memory take about ten times that, and a task sorts a bucket's rows.
BUCKET_BYTES = 8 << 20


def bucket_count(spark: SparkSession, largest: DataFrame | None = None) -> int:
    """Buckets for the order-keyed role tables (0 = plain files).

    ``retentia.roles.orderBuckets``; by default the shuffle partition count, so
    the bucketed side lines up with the shuffled side of any other join, or as many
    as keep a bucket of ``largest`` (by its estimated size) within ``BUCKET_BYTES``.
    A bucket is one scan task that AQE does not split.
    """
    value = spark.conf.get(CONF_BUCKETS, None)
    if value is not None:
        return int(value)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if largest is None:
        return least
    size = int(str(largest._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // BUCKET_BYTES))


def roles_for(spark: SparkSession, sf_dir: str) -> Roles:
    """Role tables for a folder: materialized once per application unless disabled.

    ``retentia.roles.materialize=false`` derives them lazily inside each query.
    """
    if spark.conf.get(CONF_MATERIALIZE, "true").lower() != "true":
        return Roles(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        layer = _LAYERS.get(key)
        if layer is None:
            layer = _LAYERS[key] = MaterializedRoles.build(spark, sf_dir)
    return layer


class CleanedRoles(Roles):
    """Role tables read from a cleaned layer written by ``build_cleaned_layer``.

    This is how the registered queries run on real extracts instead of the
    test-data adapter: load the CSVs once, then point the queries here.
    """

    _FOLDERS = {"category_translation": "product_category_name_translation"}

    def __init__(self, spark: SparkSession, cleaned_dir: str, database: str | None = None):
        super().__init__(spark, VersionedFolder(spark, cleaned_dir).current() or cleaned_dir)
        for name in ROLE_TABLES:
            folder = self._FOLDERS.get(name, name)
            if name == "geolocation_raw":
                # the rows before the collapse, from the raw layer
                raw = self.raw_table("geolocation")
                self.__dict__[name] = raw.toDF(*[c.removeprefix("geolocation_") for c in raw.columns])
            elif database and spark.catalog.tableExists(f"{database}.{folder}"):
                # catalog table: keeps its bucketing (co-located order joins)
                self.__dict__[name] = spark.table(f"`{database}`.`{folder}`")
            else:
                self.__dict__[name] = spark.read.parquet(f"{self.sf_dir}/{folder}")

    def raw_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/_raw/{name}")
