"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the operators are written for: ANSI casts (fail fast like PostgreSQL),
# a UTC session time zone (all timestamps are TIMESTAMP_NTZ, whose arithmetic
# does not depend on it, but casts from text do), and AQE so shuffle partition
# counts and skewed joins are re-planned at runtime.
REQUIRED_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "retentia",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the configuration the operators expect.

    On a cluster ``master`` stays ``None`` and the submitter's settings win;
    locally pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(key, REQUIRED_CONF[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is. Only when nothing is configured (local runs, tests) it is set to a
    folder of ``RETENTIA_SCRATCH``, or of the session's warehouse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster run needs a shared "
                "checkpoint folder (a machine-local folder would not survive "
                "executor loss)")
        home = os.environ.get("RETENTIA_SCRATCH") or spark.conf.get("spark.sql.warehouse.dir")
        configured = f"{home.rstrip('/')}/retentia-checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
