"""Shared plumbing of the training-data operators.

* ``materialize`` writes an intermediate under ``spark.checkpoint.dir`` and
  reads it back: lineage is cut and a lost executor costs a re-read, never a
  recomputation of data that later steps already refer to.
* ``map_blocks`` runs a function over bounded blocks of (doc_id, text): Arrow
  batches are cut into blocks of at most ``BLOCK_BYTES`` of text (a longer
  document is a block of its own), so a worker's memory does not depend on how
  Spark fills its batches.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retentia.session import checkpoint_dir

BLOCK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, each finished job's shuffle files are removed; for chains of jobs whose results are written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def hashed_share(share: Column | float) -> Column:
    """True for this share of the rows (of ``doc_id`` and ``text``), however small: alike rows are in or out together."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(1 << 62)) < share * F.lit(float(1 << 62))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so extra or clashing columns cannot interfere."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty. Offsets start at 0."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def block_ranges(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges holding at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Freed memory goes back to the system, which Arrow's pool and the C heap else keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             clear: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, without what its task would leave: reused workers wait idle beside stages that need the memory.

    ``clear`` drops the task's caches.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear is not None:
                clear()
            release()

    return task


def map_blocks(docs: DataFrame, schema: str | StructType, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None],
               limit: int = BLOCK_BYTES, clear: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``f`` to blocks of the rows of ``docs`` (which has a ``text`` column); ``clear`` drops its caches when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            _, offs = utf8(batch.column(k))
            for i, j in block_ranges(offs, limit):
                out = f(batch.slice(i, j - i))
                if out is None:
                    continue
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return docs.mapInArrow(released(run, clear), schema)


def id_array(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id"))


def text_array(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


@contextmanager
def uncollected(clear: Callable[[], None]) -> Iterator[None]:
    """For a task with large caches that hold no cycles: no garbage collection while it runs, and ``clear`` when it ends.

    A reused worker then starts its next task with the collector on and without the caches.
    """
    gc.disable()
    try:
        yield
    finally:
        clear()
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
