"""The run event log: what came after a sequence number, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def events_after(events: DataFrame, positions: DataFrame | int, run_id: str | None = None) -> DataFrame:
    """Events beyond a sequence number, or beyond each run's own (run_id, last_sequence)."""
    if isinstance(positions, int):
        later = events.where(F.col("sequence") > positions)
        return later if run_id is None else later.where(F.col("run_id") == run_id)
    seen = positions.select("run_id", "last_sequence")
    joined = events.join(seen, "run_id", "left")
    return joined.where(F.col("sequence") > F.coalesce("last_sequence", F.lit(0))).drop("last_sequence")


def event_feed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream; the checkpoint of the query that reads it remembers the position."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
