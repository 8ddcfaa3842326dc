"""Sinks: writers that refuse to overwrite, run folders, provenance, chunk rows of facts."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import hash_id


def write_new(rows: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write to a path that must not exist."""
    writer = rows.write.mode("errorifexists").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def run_path(base: str) -> str:
    """A folder name of its own for a run."""
    return f"{base.rstrip('/')}/run-{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def provenance(files: DataFrame) -> DataFrame:
    """One row: the number of files and a digest over their (path, sha256), sorted. Files are listed, not read again."""
    lines = F.array_sort(F.collect_list(F.concat_ws("\0", "path", "sha256")))
    return files.agg(F.count("*").alias("n_files"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def fact_chunks(facts: DataFrame, chunks: DataFrame, hinted: DataFrame) -> DataFrame:
    """A chunk for each fact, in the layer of the lifecycle if a selected template hints at its type."""
    hint = hinted.select("company_id", "fact_type").distinct().withColumn("_hint", F.lit(True))
    rows = facts.join(chunks.select("chunk_id", "source_version_id"), "chunk_id").join(hint, ["company_id", "fact_type"], "left")
    layer = F.when(F.col("_hint"), "lifecycle").otherwise("enterprise")
    text = F.concat_ws(" ", "subject", "predicate", "object_value")
    return rows.select(hash_id("kch_", F.lit("derived_fact"), F.lit("technology_fact"), "source_version_id", "fact_id").alias("chunk_id"), "source_id", "source_version_id", "company_id", layer.alias("knowledge_layer"), text.alias("text"), F.map_from_arrays(F.array(F.lit("semantic_kind")), F.array(F.lit("technology_fact"))).alias("metadata"))
