"""Reports: normalised rows nested to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.claims import representatives


def source_reports(docs: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """source and report: counts, language distribution, the best documents with digests, and gaps."""
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    n = rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("quality").alias("good"))
    summary = n.groupBy("source").agg(
        F.sum("n").alias("documents"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("languages"),
        F.sum("labelled").alias("labelled"),
        F.sum("good").alias("good"),
    )
    # rows of the best few only; a source's other rows are counted, not gathered
    best = representatives(rows.select("source", F.col("doc_id").alias("fact_id"), "lang", "n_chars", "text", F.when(F.col("quality") == 1, 0).when(F.col("quality").isNull(), 1).otherwise(2).alias("rank"), F.lit(None).cast("timestamp").alias("event_time")), ["source"], k)
    cited = best.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "fact_id", "lang", F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 80).alias("excerpt")))).alias("evidence"))
    gaps = F.filter(F.array(F.when(F.col("labelled") == 0, F.lit("no label")), F.when(F.size("languages") < 2, F.lit("one language only"))), lambda g: g.isNotNull())
    whole = F.struct("documents", "evidence", gaps.alias("gaps"), "good", "labelled", "languages")
    return summary.join(cited, "source", "left").select("source", F.to_json(whole).alias("report"))


def checks(report: DataFrame, evidence: DataFrame) -> DataFrame:
    """References of reports that no evidence row has."""
    refs = report.select("source", F.explode(F.from_json("report", "evidence array<struct<fact_id: long>>").getField("evidence")).alias("e")).select("source", F.col("e.fact_id").alias("fact_id"))
    return refs.join(evidence.select("fact_id"), "fact_id", "left_anti")
