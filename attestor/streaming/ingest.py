"""Streaming ingest (an extension): captures come in batches, versions are rebuilt for the sources they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestor.operators.versions import rebuild


def ingest(captures: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch to a log, once: a batch that is run again replaces its own part."""

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).drop("batch").write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = captures.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def versions(log: DataFrame) -> DataFrame:
    """Versions of all captures logged so far; late captures of old versions stay non-current."""
    return rebuild(log.select("source_id", "content_hash", "retrieved_at", "arrival"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
