"""The shared knowledge base: filtered vector search against current versions, vector upserts and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import clamp
from attestor.operators.retrieval import cosine


def versions_in_order(versions: DataFrame) -> DataFrame:
    """Versions with their place in the history of their source: by retrieval, then id."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("retrieved_at", "source_version_id")))


def chunks_of_version(chunks: DataFrame, version: str | Column) -> DataFrame:
    return chunks.where(F.col("source_version_id") == version).orderBy("chunk_id")


def filtered(index: DataFrame, company=None, layers: tuple = (), kinds: tuple = ()) -> DataFrame:
    """Rows marked current of a company, of any of the layers and of any of the source types; what isn't given isn't asked."""
    out = index.where("is_current")
    for column, wanted in (("company_id", () if company is None else (company,)), ("layer", layers), ("source_type", kinds)):
        if wanted:
            out = out.where(F.col(column).isin(*dict.fromkeys(wanted)))
    return out


def search(index: DataFrame, queries: DataFrame, versions: DataFrame, k: int = 10, **scope) -> DataFrame:
    """query_id, chunk_id, source_id, score, rank: the k nearest of the filtered index, of which those stay whose version
    is still the current one of its source, so there may be fewer than k. Scores are clamped to 0 .. 1."""
    own = filtered(index, **scope)
    hits = cosine(own.select(F.col("chunk_id").alias("doc_id"), "vector"), queries, k).withColumnRenamed("doc_id", "chunk_id")
    now = versions.where("is_current").select("source_id", "source_version_id")
    found = hits.join(own.select("chunk_id", "source_id", "source_version_id"), "chunk_id").join(now, ["source_id", "source_version_id"])
    return found.select("query_id", "chunk_id", "source_id", clamp(F.col("score")).alias("score"), "rank")


def storage_id(task: Column, document: Column, chunk: Column) -> Column:
    return F.concat_ws(":", task, document, chunk)


def upsert_vectors(index: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The index with the chunks' vectors in place of those of the same storage id; a missing page is -1. Chunks without a
    vector are an error, which is raised where the rows are read."""
    fresh = chunks.join(vectors, "chunk_id", "left").withColumn("storage_id", storage_id(F.col("task_id"), F.col("document_id"), F.col("chunk_id")))
    fresh = fresh.withColumn("vector", F.coalesce("vector", F.raise_error(F.concat(F.lit("no vector for "), "storage_id")).cast(vectors.schema["vector"].dataType)))
    fresh = fresh.withColumn("page", F.coalesce("page", F.lit(-1))).select("storage_id", "chunk_id", "page", "vector")
    return index.join(fresh.select("storage_id"), "storage_id", "left_anti").unionByName(fresh)


def reconcile(index: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """chunk_id, source_version_id, is_current and action of the index after the versions' state: chunks of current versions
    are embedded unless the index has them as current of the same version; rows of other versions are retired, not dropped."""
    now = versions.where("is_current").select("source_version_id").distinct().withColumn("_now", F.lit(True))
    wanted = chunks.join(now, "source_version_id").select("chunk_id", F.col("source_version_id").alias("wanted"))
    had = index.select("chunk_id", F.col("source_version_id").alias("had"), F.col("is_current").alias("was"))
    both = had.join(wanted, "chunk_id", "full")
    keeps = F.col("wanted").isNotNull()
    action = F.when(keeps & F.col("was") & (F.col("had") == F.col("wanted")), "unchanged").when(keeps & F.col("had").isNotNull(), "embedded_again").when(keeps, "embedded").when(F.col("was"), "retired").otherwise("retired_before")
    return both.select("chunk_id", F.coalesce("wanted", "had").alias("source_version_id"), keeps.alias("is_current"), action.alias("action"))
