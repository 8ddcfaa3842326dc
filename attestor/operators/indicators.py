"""Indicator rules of a document, with our own English keywords, and strengths and risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.rules import affirmed, cascade

NEGATIONS = ["not ", "no ", "without", "plan", "will ", "expected", "intend", "lack", "never", "pending"]


def _any(text: Column, *words: str) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def technology(text: Column) -> dict[str, Column]:
    """Scores of the four technology indicators; null without evidence."""
    low = F.lower(text)
    yes = lambda *w: affirmed(text, list(w), NEGATIONS)
    groups = [("new algorithm", "novel method"), ("new material", "novel process"), ("first of its kind", "breakthrough"), ("award", "prize")]
    novelty = sum((_any(low, *g).cast("int") for g in groups), F.lit(0))
    return {
        "autonomy": cascade([(yes("independently developed", "own core technology"), 80), (yes("jointly developed", "co-developed"), 60), (_any(low, "licensed from", "relies on supplier"), 35)]),
        "innovation": F.when(novelty > 0, F.least(F.lit(100), 40 + 15 * novelty)),
        "protection": cascade([(yes("granted patent", "patents granted"), 80), (_any(low, "patent application", "patent pending"), 55), (_any(low, "no patent"), 40)]),
        "maturity": cascade([(yes("mass production", "trl 8", "trl 9"), 85), (yes("pilot production", "trl 6", "trl 7"), 65), (_any(low, "prototype", "trl 4", "trl 5"), 45), (_any(low, "concept stage", "trl 2", "trl 3"), 25)]),
    }


def industry(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    yes = lambda *w: affirmed(text, list(w), NEGATIONS)
    return {
        "market": cascade([(_any(low, "shrinking market", "niche market"), 20), (yes("large market", "market leader"), 75), (_any(low, "market"), 55)]),
        "growth": cascade([(_any(low, "declining demand", "falling sales"), 20), (yes("rapid growth", "strong growth"), 75), (_any(low, "growth"), 55)]),
        "competition": cascade([(_any(low, "fierce competition", "many competitors"), 30), (yes("few competitors", "high barriers"), 70)]),
        "policy": cascade([(_any(low, "restricted by policy", "export ban"), 30), (yes("policy support", "subsidy"), 75), (_any(low, "regulation"), 50)]),
    }


def observe(docs: DataFrame, rules, entity: str = "doc_id") -> DataFrame:
    """(entity, indicator, score) rows in long form, a row for every indicator."""
    pairs = F.array(*[F.struct(F.lit(n).alias("indicator"), s.cast("double").alias("score")) for n, s in rules(F.col("text")).items()])
    return docs.select(F.col(entity).alias("entity_id"), F.explode(pairs).alias("x")).select("entity_id", "x.*")


def notes(scores: DataFrame, good: float = 60, bad: float = 40) -> DataFrame:
    """Strengths and risks of an entity by its scores."""
    kind = F.when(F.col("score") >= good, "strength").when(F.col("score") <= bad, "risk")
    return scores.withColumn("kind", kind).where("kind is not null").select("entity_id", "indicator", "kind", "score")
