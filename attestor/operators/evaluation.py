"""Evaluation: anchors, method comparison, gold and run metrics, review packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import compact, hash_id
from attestor.functions.unicode import locate


def anchors(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quote_id, doc_id, page, start, end, anchor_id and reason of quotes (quote_id, doc_id, page, quote): where they stand in
    their page's text (doc_id, page, text); unresolved ones have a reason and no id."""
    at = quotes.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left").withColumn("at", locate(F.col("text"), F.col("quote")))
    found = F.col("at.start") >= 0
    anchor = hash_id("anc_", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("at.start").cast("string"), F.col("at.end").cast("string"), F.col("quote"), length=24)
    reason = F.when(F.col("text").isNull(), "page_missing").when(~found, "quote_not_found")
    return at.select("quote_id", "doc_id", "page", F.when(found, F.col("at.start")).alias("start"), F.when(found, F.col("at.end")).alias("end"), F.when(reason.isNull(), anchor).alias("anchor_id"), reason.alias("reason"))


def evidence_hits(required: DataFrame, references: DataFrame) -> DataFrame:
    """required_id and hit: whether a reference (case_id, page, excerpt) of the case stands on the same page and holds all
    phrases, white space left out. required: required_id, case_id, page, phrases[]."""
    own = references.select("case_id", "page", compact(F.col("excerpt")).alias("x"))
    both = required.join(own, ["case_id", "page"], "left").withColumn("ok", F.coalesce(F.forall("phrases", lambda p: F.contains("x", F.regexp_replace(p, r"\s+", ""))), F.lit(False)))
    return both.groupBy("required_id").agg(F.max("ok").alias("hit"))


def compare_methods(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Of each method (method, query_id, doc_id, rank): mean recall at ks and reciprocal rank over queries with a relevant
    document, and the share of queries with at least one hit."""
    total = relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_relevant"))
    asked = ranked.select("method").distinct().join(queries.select("query_id").distinct().join(total, "query_id"), F.lit(True))  # methods are a handful
    hits = ranked.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("method", "query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    rows = asked.join(hits, ["method", "query_id"], "left")
    recall = [F.round(F.avg(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n_relevant")), 4).alias(f"recall_{k}") for k in ks]
    return rows.groupBy("method").agg(F.count("*").alias("n_queries"), *recall, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("at_least_one"))


def page_recall(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Share of each query's relevant (doc_id, page) pairs among the pages of its first k hits."""
    pages = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "page").distinct().withColumn("_hit", F.lit(1))
    found = relevant.select("query_id", "doc_id", "page").distinct().join(pages, ["query_id", "doc_id", "page"], "left")
    return found.groupBy("query_id").agg(F.round(F.count("_hit") / F.count("*"), 4).alias("page_recall"))


def replay(selected: DataFrame, quotes: DataFrame) -> DataFrame:
    """strategy, case_id, n_quotes and n_whole: how many quotes stand whole in one excerpt of each strategy's context."""
    both = selected.where("excerpt is not null").join(quotes.select("case_id", "quote_id", "quote"), "case_id")
    whole = both.groupBy("strategy", "case_id", "quote_id").agg(F.max(F.contains("excerpt", F.col("quote"))).alias("whole"))
    return whole.groupBy("strategy", "case_id").agg(F.count("*").alias("n_quotes"), F.count_if("whole").alias("n_whole"))


def gold_null(rows: DataFrame) -> DataFrame:
    """Gold rows (gold, evidence_required, told_insufficient) with their kind: scored, explicit_insufficient, unlabelled."""
    explicit = ~F.coalesce(F.col("evidence_required"), F.lit(True)) & F.coalesce(F.col("told_insufficient"), F.lit(False))
    return rows.withColumn("kind", F.when(F.col("gold").isNotNull(), "scored").when(explicit, "explicit_insufficient").otherwise("unlabelled"))


def coverage(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of rows with gold_null()'s kind and a score: gold-scored, of these predicted, error over pairs, and scores given where
    the gold says that the evidence doesn't bear one."""
    scored, paired = F.col("kind") == "scored", (F.col("kind") == "scored") & F.col("score").isNotNull()
    return rows.groupBy(*group).agg(
        F.count_if(scored).alias("n_gold"), F.count_if(paired).alias("n_paired"), F.count_if(scored & F.col("score").isNull()).alias("n_missing"),
        F.count_if((F.col("kind") == "explicit_insufficient") & F.col("score").isNotNull()).alias("n_over_scored"),
        F.round(F.avg(F.when(paired, F.abs(F.col("score") - F.col("gold")))), 4).alias("conditional_mae"), F.round(F.count_if(paired) / F.nullif(F.count_if(scored), F.lit(0)), 4).alias("coverage"),
    )


def match_rates(rows: DataFrame, group: list[str], tolerance: float, of: int | None = None) -> DataFrame:
    """Share of rows (gold, score, n_evidence) whose score is within tolerance, and of those that have evidence too, out of
    all rows or of a fixed number."""
    near = F.coalesce(F.abs(F.col("score") - F.col("gold")) <= tolerance, F.col("score").isNull() & F.col("gold").isNull())
    total = F.lit(of) if of else F.count("*")
    return rows.groupBy(*group).agg(F.round(100 * F.count_if(near) / total, 2).alias("score_match"), F.round(100 * F.count_if(near & (F.col("n_evidence") > 0)) / total, 2).alias("full_match"))


def evidence_completeness(rows: DataFrame, valid: DataFrame, group: str) -> DataFrame:
    """Share of scored rows (score, evidence_ids[]) with evidence of which all is valid for the group."""
    known = valid.groupBy(group).agg(F.collect_set("evidence_id").alias("_known"))
    whole = (F.size("evidence_ids") > 0) & (F.size(F.array_except("evidence_ids", F.coalesce("_known", F.array().cast("array<string>")))) == 0)
    return rows.where("score is not null").join(known, group, "left").groupBy(group).agg(F.round(F.count_if(whole) / F.count("*"), 4).alias("completeness"))


def mapping_coverage(rows: DataFrame, group: str, of: int = 4) -> DataFrame:
    """Mappings with any evidence out of a fixed number of them."""
    return rows.groupBy(group).agg(F.round(F.count_if(F.size("evidence_ids") > 0) / of, 4).alias("coverage"))


def mode_deltas(runs: DataFrame, base: str = "rule") -> DataFrame:
    """name, delta and values of runs (case_id, mode, name, score): each other mode's score less the base's, and the distinct
    scores of all modes in order."""
    own = runs.where(F.col("mode") == base).select("case_id", "name", F.col("score").alias("_base"))
    values = runs.groupBy("case_id", "name").agg(F.array_sort(F.collect_set("score")).alias("values"))
    return runs.where(F.col("mode") != base).join(own, ["case_id", "name"]).join(values, ["case_id", "name"]).select("case_id", "mode", "name", F.round(F.col("score") - F.col("_base"), 4).alias("delta"), "values")


def error_breakdown(runs: DataFrame, recovery: DataFrame) -> DataFrame:
    """category, n, rate and how it is recovered from, of failed runs (error) out of all."""
    total = runs.agg(F.count("*").alias("_all"))
    return runs.where("error is not null").groupBy(F.col("error").alias("category")).agg(F.count("*").alias("n")).join(recovery, "category", "left").crossJoin(total).withColumn("rate", F.round(F.col("n") / F.col("_all"), 4)).drop("_all")


def batch_report(runs: DataFrame, group: str) -> DataFrame:
    """Batches, those that went well, chunks, and a map of errors to their number."""
    errors = runs.where("error is not null").groupBy(group, "error").agg(F.count("*").alias("n")).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors"))
    return runs.groupBy(group).agg(F.count("*").alias("n_batches"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.sum("n_chunks").alias("n_chunks")).join(errors, group, "left")


def all_runs(cases: DataFrame, modes: list[str], repeats: int, outcomes: DataFrame) -> DataFrame:
    """One row for every case, mode and repeat: its outcome (case_id, mode, run, status), or not_run."""
    every = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, modes))).alias("mode")).select("case_id", "mode", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("run"))
    return every.join(outcomes, ["case_id", "mode", "run"], "left").withColumn("status", F.coalesce("status", F.lit("not_run")))


def review_packet(quotes: DataFrame, chunks: DataFrame, ranked: DataFrame, most: int = 2) -> DataFrame:
    """Of each quote (quote_id, doc_id, page, quote): the first chunk (chunk_id, doc_id, page, text) of its page that holds
    it, and for every method at most two candidates of the same page by rank."""
    page = quotes.join(chunks, ["doc_id", "page"])
    first = page.where(F.contains("text", F.col("quote"))).groupBy("quote_id").agg(F.min("chunk_id").alias("first_chunk"))
    near = ranked.join(page.select("quote_id", "chunk_id"), ["quote_id", "chunk_id"]).withColumn("n", F.row_number().over(Window.partitionBy("quote_id", "method").orderBy("rank", "chunk_id"))).where(F.col("n") <= most)
    listed = near.groupBy("quote_id", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    listed = listed.groupBy("quote_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "chunks")))).alias("candidates"))
    return quotes.select("quote_id").join(first, "quote_id", "left").join(listed, "quote_id", "left")


def review_summary(rows: DataFrame, status: str, sample: int = 20) -> DataFrame:
    """Status, number, and the first ids of each status."""
    place = F.row_number().over(Window.partitionBy(status).orderBy("id"))
    first = rows.withColumn("_n", place).where(F.col("_n") <= sample).groupBy(status).agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    return rows.groupBy(status).agg(F.count("*").alias("n")).join(first, status)


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 4)
