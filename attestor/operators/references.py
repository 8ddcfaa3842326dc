"""Local references of model output, stable distinct sets, first matches, and gates over candidate pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import clauses, fold, normal_key, safe_ref

# --- local references --------------------------------------------------------


def ordinals(rows: DataFrame, group: str, order: list[str], prefix: str, start: int = 1) -> DataFrame:
    """Rows with ref = prefix and their place in the group, counted from start."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) + (start - 1)
    return rows.withColumn("ref", F.concat(F.lit(prefix), place.cast("string")))


def resolve(drafts: DataFrame, rows: DataFrame, group: str, prefix: str, key: str) -> DataFrame:
    """Drafts (group, refs[]) with the keys that their references stand for, in order and once, the references that stand
    for nothing, and how many were repeated. rows: group, ref and key."""
    each = drafts.select(group, F.posexplode("refs").alias("at", "raw")).withColumn("ref", safe_ref(F.col("raw"), prefix))
    found = each.join(rows.select(group, "ref", F.col(key).alias("_key")), [group, "ref"], "left")
    first = found.groupBy(group, F.coalesce("ref", "raw").alias("name")).agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("_key").alias("_key"))
    in_order = lambda c, what: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", F.col(what).alias("v"))))), lambda x: x["v"])
    out = first.groupBy(group).agg(in_order(F.col("_key").isNotNull(), "_key").alias("keys"), in_order(F.col("_key").isNull(), "name").alias("invalid"), F.sum(F.col("n") - 1).alias("n_repeated"))
    return drafts.select(group).distinct().join(out, group, "left")


def bound_fields(drafts: DataFrame) -> DataFrame:
    """Evidence and the fields it supports, sorted; evidence that supports none goes. drafts: evidence_id, supports[]."""
    return drafts.select("evidence_id", F.explode("supports").alias("f")).groupBy("evidence_id").agg(F.array_sort(F.collect_set("f")).alias("supports"))


def classified(drafts: DataFrame, evidence: DataFrame, registry: list[str]) -> DataFrame:
    """Classification drafts (company_id, status, domains[], domain_refs[], templates array<struct<template_id, refs>>) with
    references resolved: without valid evidence a classification falls to insufficient_evidence and loses its domains, and
    templates without any are dropped; unknown domains are listed. evidence: company_id, ref, chunk_id."""
    known = evidence.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "chunk_id"))).alias("known"))
    rows = drafts.join(known, "company_id", "left").withColumn("known", F.coalesce("known", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    valid = lambda refs: F.filter(F.array_distinct(F.transform(refs, lambda r: F.element_at("known", F.upper(F.trim(r))))), lambda x: x.isNotNull())
    domain = valid(F.col("domain_refs"))
    kept = F.filter(F.transform("templates", lambda t: F.struct(t["template_id"].alias("template_id"), valid(t["refs"]).alias("chunks"))), lambda t: F.size(t["chunks"]) > 0)
    falls = (F.col("status") == "classified") & (F.size("domain_chunks") == 0)
    out = rows.withColumn("domain_chunks", domain).withColumn("kept", kept).withColumn("downgraded", falls)
    return out.select(
        "company_id", F.when(falls, "insufficient_evidence").otherwise(F.col("status")).alias("status"), F.when(falls, F.array().cast("array<string>")).otherwise(F.col("domains")).alias("domains"),
        "domain_chunks", F.col("kept").alias("templates"), (F.size("templates") - F.size("kept")).alias("n_dropped"), "downgraded",
        F.array_except("domains", F.array(*map(F.lit, registry))).alias("unknown_domains"),
    )


# --- sets in order -----------------------------------------------------------


def stable_distinct(rows: DataFrame, group: list[str], key: Column, order: str, last: bool = False) -> DataFrame:
    """One row for each key of a group: the first by order, or the last."""
    by = F.struct(order, F.struct(*rows.columns)) if order not in group else F.struct(F.struct(*rows.columns))
    best = rows.groupBy(*group, key.alias("_key")).agg((F.max if last else F.min)(by).alias("_row"))
    return best.select("_row.col2.*" if order not in group else "_row.col1.*")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with their part's number and place: (part, at) is the order of the whole."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("part", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def fresh_queries(queries: DataFrame, executed: DataFrame, company: str | None = None, known_terms: list[str] | None = None) -> DataFrame:
    """Queries (at, query) not asked before, each once by its folded form: initial ones get the company's name put before
    them where it is missing, follow-up ones must hold a known term."""
    queries, text = queries.where(F.trim("query") != ""), F.trim("query")
    if company is not None:
        has = F.contains(normal_key(text), F.lit(" ".join(company.casefold().split())))
        text = F.when(has, text).otherwise(F.concat(F.lit(company + " "), text))
    own = queries.select("at", text.alias("query")).withColumn("key", normal_key(F.col("query"))).where("key <> ''")
    if known_terms is not None:
        own = own.where(F.col("key").rlike("|".join(re.escape(t.casefold()) for t in known_terms)) if known_terms else F.lit(False))
    first = own.groupBy("key").agg(F.min(F.struct("at", "query")).alias("q"))
    asked = executed.select(normal_key(F.col("query")).alias("key")).distinct()
    return first.join(asked, "key", "left_anti").select("q.at", "q.query")


# --- first matches -----------------------------------------------------------

#: Marks of plans and negations, and phrases that take a claim back.
NOT_YET = ("尚未", "未完成", "未获得", "待验证", "建议", "计划", "预计", "拟", "目标", "需要", "需提供", "不能")
TAKEN_BACK = ("不能证明", "不能推出", "不能认定", "无法证明", "无法推出", "不支持", "尚不能")


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def first_match(evidence: DataFrame, group: str, at: str, keywords: list[str]) -> DataFrame:
    """Of each group the first row whose text holds a keyword."""
    hit = evidence.where(_any(F.col("text"), keywords))
    return hit.groupBy(group).agg(F.min_by(F.struct(*[c for c in evidence.columns if c != group]), at).alias("r")).select(group, "r.*")


def first_affirmed(evidence: DataFrame, group: str, at: str, keywords: list[str], required: list[str] | None = None, marks: tuple[str, ...] = NOT_YET) -> DataFrame:
    """Of each group the first row with a clause that holds a keyword, no mark of a plan or negation, and a required word if
    any are given: the whole row."""
    good = lambda c: _any(c, keywords) & ~_any(c, marks) & (_any(c, required) if required else F.lit(True))
    hit = evidence.where(F.exists(clauses(F.col("text")), good))
    return hit.groupBy(group).agg(F.min_by(F.struct(*[c for c in evidence.columns if c != group]), at).alias("r")).select(group, "r.*")


def taken_back(reason: Column, mark: Column, reach: int = 12) -> Column:
    """Whether the first occurrence of a mark has a phrase that takes it back among the characters before it."""
    low = fold(reason)
    place = F.instr(low, F.lower(mark))
    before = F.substring(low, F.greatest(F.lit(1), place - reach), F.least(F.lit(reach), place - 1))
    return (place > 0) & before.rlike("|".join(TAKEN_BACK))


def occurs(quote: Column, *parts: Column) -> Column:
    """Whether a quote stands in the parts together, both normalised; an empty quote doesn't."""
    own = normal_key(quote)
    return F.coalesce((own != "") & F.contains(normal_key(F.concat_ws("\n", *parts)), own), F.lit(False))


def claims_in_pages(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims (claim_id, quote, urls[]) and whether the quote stands in their cited pages (canonical, content) together."""
    cited = claims.select("claim_id", "quote", F.posexplode_outer("urls").alias("at", "canonical")).join(pages.select("canonical", "content"), "canonical", "left")
    text = cited.groupBy("claim_id").agg(F.first("quote").alias("quote"), F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]).alias("texts"))
    return text.select("claim_id", occurs(F.col("quote"), F.array_join("texts", "\n")).alias("found"))


#: Fixed value: marks of gaps that the system makes itself.
SYSTEM_GAPS = ("model call", "invalid json", "budget", "fallback", "timeout")


def reader_gaps(gaps: DataFrame, group: str, at: str, marks: tuple[str, ...] = SYSTEM_GAPS) -> DataFrame:
    """Gaps without those that speak of the system (_ and - read as blanks), each once, the first stays."""
    plain = F.regexp_replace(F.lower("gap"), "[_-]", " ")
    return gaps.where(~_any(plain, marks)).groupBy(group, "gap").agg(F.min(at).alias(at))


def primary_chunks(chunks: DataFrame, layers: tuple[str, ...] = ("general", "enterprise"), most: int = 60) -> DataFrame:
    """Chunks of the layers that aren't derived facts, the first `most` of each company by version and id."""
    kind = F.coalesce(F.col("semantic_kind"), F.lit(""))
    own = chunks.where(F.col("layer").isin(*layers) & ~kind.isin("technology_fact", "financial_fact"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("source_version_id", "chunk_id"))
    return own.withColumn("place", place).where(F.col("place") <= most)


# --- gates -------------------------------------------------------------------


def relevance(pages: DataFrame, decisions: DataFrame, trusted: DataFrame, official: Column, by: str = "canonical") -> DataFrame:
    """canonical, status, origin and downgrade of candidate pages (page_id, canonical, host, content): pages that have proven
    the identity or stand on the official host are relevant at once; for the others a decision (page_id, status, quote) counts
    if it is the only one and its quote stands in the page. Missing, repeated and unproven decisions are uncertain. What is
    proven holds for all pages of the same `by`: of a URL, or with page_id for the page alone."""
    proven = trusted.select(by).distinct().withColumn("_proven", F.lit(True))
    each = decisions.groupBy("page_id").agg(F.count("*").alias("n"), F.first("status").alias("said"), F.first("quote").alias("quote"))
    rows = pages.join(proven, by, "left").join(each, "page_id", "left")
    on_host = (F.col("host") == official) | F.endswith(F.col("host"), F.concat(F.lit("."), official))
    origin = F.when(F.col("_proven"), "identity_evidence").when(on_host, "official_host")
    fault = F.when(F.col("n").isNull(), "missing_model_decision").when(F.col("n") > 1, "duplicate_model_decision").when((F.col("said") != "uncertain") & ~occurs(F.col("quote"), F.col("content")), "evidence_quote_not_verified")
    rows = rows.withColumn("origin", origin).withColumn("downgrade", F.when(F.col("origin").isNull(), fault))
    status = F.when(F.col("origin").isNotNull(), "relevant").when(F.col("downgrade").isNotNull(), "uncertain").otherwise(F.col("said"))
    return rows.select("page_id", "canonical", status.alias("status"), F.coalesce("origin", F.when(F.col("downgrade").isNotNull(), "model_downgraded").otherwise("model")).alias("origin"), "downgrade")


def decided(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """Search results with the decision of their canonical URL."""
    return results.join(decisions.select("canonical", "status", "origin"), "canonical")


#: Fixed value: words that stand for the company itself.
GENERIC = ("公司", "本公司", "该公司", "企业", "本企业", "该企业")


def canonical_subject(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts whose subject is one of the company's names (company_id, name), or a word for it, as __company__."""
    names = aliases.select("company_id", normal_key(F.col("name")).alias("_subject")).where("_subject <> ''").distinct().withColumn("_alias", F.lit(True))
    rows = facts.withColumn("_subject", F.coalesce(normal_key(F.col("subject")), F.lit(""))).join(names, ["company_id", "_subject"], "left")
    return rows.withColumn("subject", F.when(F.col("_alias") | F.col("_subject").isin(*GENERIC), "__company__").otherwise(F.col("_subject"))).drop("_subject", "_alias")
