"""retentia: retail order analytics and retention operators on Apache Spark.

Every public operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` so that Catalyst plans it and the work runs on the
executors. Sub-packages:

* ``sources``   - raw CSV ingest, table schemas, sinks, role adapters
* ``functions`` - column-level helpers (PostgreSQL-compatible scalar semantics)
* ``operators`` - cleaning, data-quality and analytics operators
* ``plans``     - the registry of named queries and their SQL oracles
* ``streaming`` - incremental (Structured Streaming) ingest of the raw layer
"""

from retentia.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
