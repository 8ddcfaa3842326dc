"""Weighted scores with missing values, composites, sensitivity, and prediction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(score: Column, weight: Column) -> Column:
    """Mean over the scores that are there, weights renormalised to them; null if there is none."""
    there = F.when(score.isNotNull(), weight)
    return F.round(F.sum(score * weight) / F.nullif(F.sum(there), F.lit(0.0)), 2)


def evaluate(long: DataFrame, weights: DataFrame, entity: str = "entity_id") -> DataFrame:
    """From (entity, indicator, score) and (indicator, dimension, weight): a row for each entity and dimension, and one
    with a null dimension for the total; how many indicators are scored, and the status."""
    whole = long.select(entity).distinct().crossJoin(F.broadcast(weights))  # the indicators are a handful of rows
    rows = whole.join(long.select(entity, "indicator", "score"), [entity, "indicator"], "left")
    out = rows.groupingSets([[entity, "dimension"], [entity]], entity, "dimension").agg(
        weighted_mean(F.col("score"), F.col("weight")).alias("score"),
        F.count("score").alias("n_scored"),
        F.count("*").alias("n_indicators"),
        F.grouping("dimension").alias("is_total"),
    )
    status = F.when(F.col("n_scored") == 0, "insufficient_evidence").when(F.col("n_scored") < F.col("n_indicators"), "partially_scored").otherwise("fully_scored")
    return out.withColumn("status", status)


def check_weights(weights: DataFrame) -> DataFrame:
    """Violations: (check, detail) rows; none if the weights are non-negative, unique and sum to one."""
    total = weights.agg(F.sum("weight").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).select(F.lit("sum").alias("check"), F.col("s").cast("string").alias("detail"))
    negative = weights.where("weight < 0").select(F.lit("negative").alias("check"), F.col("indicator").alias("detail"))
    twice = weights.groupBy("indicator").count().where("count > 1").select(F.lit("duplicate").alias("check"), F.col("indicator").alias("detail"))
    return total.unionByName(negative).unionByName(twice)


def composite(technology: Column, industry: Column, w_technology: float | Column = 0.6, w_industry: float | Column = 0.4) -> Column:
    """Weighted sum; null if either is missing (weights are not renormalised)."""
    return F.round(technology * w_technology + industry * w_industry, 2)


def sensitivity(cases: DataFrame, shares: tuple[float, ...] = (0.8, 0.6, 0.4, 0.2)) -> DataFrame:
    """Composite of each case under each share of technology, its rank, and whether the rank differs from the scenario
    before."""
    spark = cases.sparkSession
    scenarios = spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "scenario int, share double")
    scored = cases.crossJoin(F.broadcast(scenarios)).withColumn("overall", composite(F.col("technology"), F.col("industry"), F.col("share"), 1 - F.col("share")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc_nulls_last("overall"), "case_id")))
    before = F.lag("rank").over(Window.partitionBy("case_id").orderBy("scenario"))
    return ranked.withColumn("moved", F.coalesce(F.col("rank") != before, F.lit(False)))


def error_measures(gold: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE and shares within tolerances over pairs that are both there; coverage of the gold scores."""
    gap = F.abs(gold - predicted)
    both = gap.isNotNull()
    return [
        F.count(gold).alias("n_gold"),
        F.count(gap).alias("n_paired"),
        F.count_if(gold.isNotNull() & predicted.isNull()).alias("n_empty"),
        F.round(F.avg(gap), 4).alias("mae"),
        F.round(F.sqrt(F.avg(gap * gap)), 4).alias("rmse"),
        F.round(F.avg(F.when(both, (gap == 0).cast("double"))), 4).alias("exact_rate"),
        F.round(F.avg(F.when(both, (gap <= 5).cast("double"))), 4).alias("within_5"),
        F.round(F.avg(F.when(both, (gap <= 10).cast("double"))), 4).alias("within_10"),
        F.round(F.try_divide(F.count(gap), F.count(gold)), 4).alias("coverage"),
    ]


def stability(x: Column) -> list[Column]:
    """n, mean, population deviation, extremes and range."""
    return [
        F.count(x).alias("n"),
        F.round(F.avg(x), 4).alias("mean"),
        F.round(F.stddev_pop(x), 4).alias("stddev"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.round(F.max(x) - F.min(x), 4).alias("spread"),
    ]


def rate(flag: Column) -> Column:
    """Percentage of true; 100 where there is nothing to count."""
    return F.when(F.count(flag) == 0, F.lit(100.0)).otherwise(F.round(100 * F.avg(flag.cast("double")), 2))
