"""Iterative research as a bounded driver loop over DataFrames: search, dedupe, take in, plan the next round.

A round's state is written to the shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import canonical_url, normal_key, terms

ROUNDS, QUERIES, RESULTS, SOURCES = 3, 6, 5, 25


def search(pages: DataFrame, queries: list[str], results: int = RESULTS) -> DataFrame:
    """Pages that hold all terms of a query, by how often the first one stands there; at most `results` a query."""
    found = None
    for i, q in enumerate(queries):
        words = q.lower().split()
        low = F.lower("content")
        hit = pages
        for w in words:
            hit = hit.where(F.contains(low, F.lit(w)))
        part = hit.select(F.lit(i).alias("query_no"), "result_id", "url", "content", F.regexp_count(low, F.lit(r"\Q" + words[0] + r"\E")).alias("weight")).orderBy(F.desc("weight"), "result_id").limit(results)
        found = part if found is None else found.unionByName(part)
    return found


def dedupe(results: DataFrame) -> DataFrame:
    """One row a canonical URL: the first, with the longest content that any of its rows has."""
    rows = results.withColumn("canonical", canonical_url(F.col("url"))).where("canonical is not null")
    return rows.groupBy("canonical").agg(F.min(F.struct("query_no", "result_id")).alias("first"), F.max_by("content", F.struct(F.length("content"), "result_id")).alias("content"))


def planner(taken: DataFrame, executed: list[str], queries: int) -> list[str]:
    """Follow-up queries: the most frequent terms of the pages taken in that no query has had. A model may be put here."""
    known = {w for q in executed for w in q.split()}
    words = taken.select(F.explode(F.array_distinct(terms(F.col("content")))).alias("w")).where(F.length("w") >= 5).groupBy("w").count()
    rows = words.where(~F.col("w").isin(*known)).orderBy(F.desc("count"), "w").limit(queries).collect()
    return [r["w"] for r in rows]


def run(pages: DataFrame, first: list[str], rounds: int = ROUNDS, queries: int = QUERIES, sources: int = SOURCES, plan: Callable[[DataFrame, list[str], int], list[str]] = planner) -> DataFrame:
    """canonical, round, result_id and n_chars of the sources taken in, and why the loop stopped."""
    spark = pages.sparkSession
    if not spark.sparkContext.getCheckpointDir():  # the cluster's shared folder; one of our own in local mode only
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="attestor-"))
    executed: list[str] = []
    asked, taken, n, reason = first, None, 0, "max_rounds"
    for number in range(1, rounds + 1):
        seen = {" ".join(q.lower().split()) for q in executed}
        asked = list(dict.fromkeys(q for q in (" ".join(q.lower().split()) for q in asked) if q and q not in seen))[:queries]
        if not asked:
            reason = "no_grounded_followup_queries"
            break
        new = dedupe(search(pages, asked))
        if taken is not None:
            new = new.join(taken.select("canonical"), "canonical", "left_anti")
        new = new.orderBy("first", "canonical").limit(sources - n).withColumn("round", F.lit(number)).checkpoint(eager=True)
        executed += asked
        gained = new.count()
        if not gained:
            reason = "no_information_gain"
            break
        taken = new if taken is None else taken.unionByName(new)
        n += gained
        if n >= sources:
            reason = "max_sources"
            break
        asked = plan(taken, executed, queries)
    if taken is None:
        return spark.createDataFrame([], "canonical string, round int, result_id string, n_chars int, stopped string")
    return taken.select("canonical", "round", F.col("first.result_id").alias("result_id"), F.length("content").alias("n_chars"), F.lit(reason).alias("stopped"))


def grounded(queries: DataFrame, corpus: DataFrame, least: int = 2) -> DataFrame:
    """Queries of which a term of at least `least` letters stands in the corpus: an equi-join on terms."""
    own = queries.select("query", F.explode(F.array_distinct(terms(normal_key(F.col("query"))))).alias("w")).where(F.length("w") >= least)
    words = corpus.select(F.explode(F.array_distinct(terms(F.col("content")))).alias("w")).distinct()
    return own.join(words, "w", "left_semi").select("query").distinct()
