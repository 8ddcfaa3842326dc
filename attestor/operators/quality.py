"""Data-quality checks: each gives rows of violations, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, entity: str, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(check, entity, detail) for each row and check that it breaks; all checks in one pass."""
    hits = F.array(*[F.when(bad, F.struct(F.lit(name).alias("check"), F.col(detail).cast("string").alias("detail"))) for name, (bad, detail) in checks.items()])
    found = rows.select(F.col(entity).cast("string").alias("entity"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return found.select("h.check", "entity", "h.detail")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """One row for each surplus row of a key."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return n.select(key, F.explode(F.sequence(F.lit(2), "_n")).alias("_k"))


def integrity(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks])


def citations(answers: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """References [E1] in answers: how many, how many the evidence of the same key has."""
    refs = answers.select(key, F.explode(F.regexp_extract_all("answer", F.lit(r"\[([A-Z]\d+)\]"), F.lit(1))).alias("ref"))
    found = refs.join(evidence.select(key, "ref").distinct().withColumn("_ok", F.lit(True)), [key, "ref"], "left")
    return found.groupBy(key).agg(F.count("*").alias("n_refs"), F.count("_ok").alias("n_valid"), F.round(100 * F.count("_ok") / F.count("*"), 2).alias("valid_rate"))


def split(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); an unknown outcome rejects."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


FORBIDDEN = ("score", "rating", "investment_advice", "recommendation")


def forbidden_keys(payload: str, keys: tuple[str, ...] = FORBIDDEN) -> Column:
    """Top-level keys of a JSON object that must not be there."""
    return F.array_intersect(F.json_object_keys(payload), F.array(*map(F.lit, keys)))
