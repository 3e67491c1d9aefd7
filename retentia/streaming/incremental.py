"""Incremental load of raw extracts with Structured Streaming.

New CSV files dropped into a landing folder are picked up, cleaned with the
same row-wise cleaners as the batch load and appended to the cleaned table.
The file source and the Parquet sink together give exactly-once appends: the
checkpoint records which files were committed, so a restarted query (or one
whose executors were lost) neither skips nor duplicates a file, the
re-runnable, key-safe replacement of a plain append of the whole file.

Only row-wise tables stream this way; geolocation collapses many rows per
zip prefix (an aggregation over all data), so it stays a batch rebuild.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from retentia.operators.clean import CLEANERS
from retentia.sources.schemas import raw_schema

STREAMABLE = tuple(t for t in CLEANERS if t != "geolocation")


def stream_cleaned(spark: SparkSession, table: str, landing_dir: str, out_dir: str,
                   checkpoint: str, available_now: bool = True,
                   max_files_per_trigger: int | None = None,
                   multiline: bool = False) -> StreamingQuery:
    """Start a streaming load of ``table`` from ``landing_dir`` into ``out_dir`` (Parquet).

    ``available_now=True`` processes everything present and stops (a
    scheduled incremental batch); ``False`` keeps watching the folder.
    """
    if table not in STREAMABLE:
        raise ValueError(f"{table} cannot be loaded incrementally; rebuild it in batch")
    reader = (spark.readStream
              .schema(raw_schema(table))
              .option("header", True)
              .option("quote", '"')
              .option("escape", '"')
              .option("multiLine", multiline)
              .option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    cleaned = CLEANERS[table](reader.csv(landing_dir))
    writer = (cleaned.writeStream
              .format("parquet")
              .option("path", out_dir)
              .option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
