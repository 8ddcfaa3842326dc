"""Versioned sources: content-addressed versions, exactly one current, idempotent upserts without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rebuild(captures: DataFrame) -> DataFrame:
    """From captures (source_id, content_hash, retrieved_at, arrival): a row a version with its latest retrieval, its
    first arrival, whether it is current, and the version it has superseded.

    A version's capture makes it current unless the current one was retrieved later; of equal times the later arrival
    wins. A version that was new when it became current supersedes the one that was current then.
    """
    by_arrival = Window.partitionBy("source_id").orderBy("arrival")
    earlier = by_arrival.rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct("retrieved_at", "arrival", "content_hash")
    seen = captures.withColumn("_best", F.max(key).over(earlier))
    # no earlier capture of the source was retrieved later: this one becomes current
    takes = F.col("_best").isNull() | (F.col("retrieved_at") >= F.col("_best.retrieved_at"))
    first = F.row_number().over(Window.partitionBy("source_id", "content_hash").orderBy("arrival")) == 1
    seen = seen.withColumn("supersedes", F.when(first & takes, F.col("_best.content_hash")))
    versions = seen.groupBy("source_id", "content_hash").agg(
        F.max("retrieved_at").alias("retrieved_at"),
        F.min("arrival").alias("first_arrival"),
        F.max("supersedes").alias("supersedes"),
        F.max(F.struct("retrieved_at", "arrival")).alias("_last"),
    )
    current = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("_last"))) == 1
    return versions.withColumn("is_current", current).drop("_last")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of their key; of several incoming rows the last by `arrival` wins."""
    last = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("arrival")))).where("_n = 1").drop("_n")
    return existing.join(last, keys, "left_anti").unionByName(last, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def delete_rows(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def current_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of current versions, newest retrieval first when shown."""
    now = versions.where("is_current").select("source_version_id", "retrieved_at")
    return chunks.join(now, "source_version_id")


def counts(companies: DataFrame, sources: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Row counts of the four tables, one row."""
    parts = [t.agg(F.count("*").alias(n)) for t, n in ((companies, "companies"), (sources, "sources"), (versions, "versions"), (chunks, "chunks"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
