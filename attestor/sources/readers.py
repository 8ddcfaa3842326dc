"""Sources: tables, JSON cases and runs, registries, binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.schemas import schema

MOST_BYTES, PDF_MAGIC = 20 << 20, b"%PDF-"


def parquet(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    return (spark.read.schema(schema(ddl)) if ddl else spark.read).parquet(path)


def json_rows(spark: SparkSession, path: str, ddl: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt records) under an explicit schema."""
    rows = spark.read.schema(schema(ddl + ", _corrupt string")).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("_file", "_corrupt")


def csv_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(schema(ddl)).option("header", True).option("mode", "PERMISSIVE").csv(path)


def registry(spark: SparkSession, path: str, key: str, ddl: str) -> DataFrame:
    """A list of a YAML file as rows; read through Spark, so that any store will do. Registries are small files."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    rows: list[dict[str, Any]] = yaml.safe_load(text)[key]
    names = schema(ddl).fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema(ddl))


def valid_upload(path: Column, length: Column, content: Column) -> Column:
    """The first reason why a file isn't a document that can be taken in; null if there is none."""
    return (
        F.when(~F.endswith(F.lower(path), F.lit(".pdf")), "extension")
        .when(length == 0, "empty")
        .when(length > MOST_BYTES, "too_large")
        .when(F.substring(content, 1, 5) != F.lit(PDF_MAGIC), "magic")
    )


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary files with their digest and the reason for a rejection."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), valid_upload(F.col("path"), F.col("length"), F.col("content")).alias("rejected"), "content")


def parse_files(found: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """path, sha256, page_number (from 1), text of the pages that have any; the parser is the caller's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.path, r.sha256, n, " ".join(t.split())) for r in frame.itertuples() for n, t in enumerate(parser(r.content), 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["path", "sha256", "page_number", "text"])

    return found.where("rejected is null").select("path", "sha256", "content").mapInPandas(run, "path string, sha256 string, page_number int, text string")


def manifest_mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (file_name, sha256) that are missing or differ."""
    own = found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("sha256").alias("actual"))
    both = manifest.join(own, "file_name", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("actual")))


def complete_companies(manifests: DataFrame) -> DataFrame:
    """Manifests (company_id, documents: array of structs) of which every document is downloaded."""
    return manifests.where((F.size("documents") > 0) & F.forall("documents", lambda d: d["status"] == "downloaded"))


def runs(saved: DataFrame) -> DataFrame:
    """Saved runs (cases: array of structs with llm_runs) as a row for each case and run."""
    return saved.select(F.explode("cases").alias("c")).select("c.case_id", F.explode("c.llm_runs").alias("r")).select("case_id", "r.*")
