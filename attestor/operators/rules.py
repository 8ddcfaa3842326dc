"""Rules: source types by host, keyword cascades, milestones, finance mapping, website attestation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import clauses, host_suffixes, url_host

# --- source types ------------------------------------------------------------


def source_type(pages: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """Type of each page by its host: the registry's host itself or one above it, in the registry's order of priority;
    else by its ending or as plain web. Hosts are joined by all their suffixes, which is an equi-join."""
    host = pages.withColumn("host", url_host(F.col(url)))
    hosts = host.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"))).alias("root"))
    best = hosts.join(registry.select(F.col("host").alias("root"), "source_type", "priority"), "root").groupBy("host").agg(F.min_by("source_type", F.struct("priority", "source_type")).alias("_type"))
    named = F.when(F.regexp_like("host", F.lit(r"\.gov(\.[a-z]{2})?$")), "government").otherwise("web")
    return host.join(best, "host", "left").withColumn("source_type", F.coalesce("_type", named)).drop("_type")


def same_site(host: Column, root: Column) -> Column:
    return (host == root) | F.endswith(host, F.concat(F.lit("."), root))


# --- keyword cascades --------------------------------------------------------


def affirmed(text: Column, keywords: list[str], negations: list[str], required: list[str] | None = None) -> Column:
    """Whether a clause holds a keyword and none of the negations, if any (and one of the required marks, if given)."""
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    good = lambda c: has(c, keywords) & (~has(c, negations) if negations else F.lit(True)) & (has(c, required) if required else F.lit(True))
    return F.exists(clauses(F.lower(text)), good)


def cascade(flags: list[tuple[Column, int]]) -> Column:
    """The score of the first flag that holds; null if none does."""
    out = F.lit(None).cast("int")
    for flag, score in reversed(flags):
        out = F.when(flag, score).otherwise(out)
    return out


def phrase_score(text: Column, phrases: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the phrases that a text holds."""
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in phrases])
    return F.aggregate(F.filter(table, lambda x: F.contains(text, x["p"])), F.lit(0), lambda s, x: s + x["w"])


def phrase_weights(phrases: DataFrame) -> DataFrame:
    """phrase and weight: selection terms of four letters weigh 3, all else 2; the most of a phrase's kinds."""
    weight = F.when((F.col("kind") == "selection_term") & (F.length("phrase") >= 4), 3).otherwise(2)
    return phrases.groupBy(F.lower("phrase").alias("phrase")).agg(F.max(weight).alias("weight"))


# --- milestones --------------------------------------------------------------

WEAK = ("snippet_only", "weak_web")


def guard_milestones(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """Drafts (company_id, milestone_id, status, supporting[], contradicting[]) with references that exist only, none on
    both sides, and the status that they bear; `downgraded` where it isn't the draft's."""
    refs = drafts.select("company_id", "milestone_id", F.explode(F.array_union("supporting", "contradicting")).alias("fact_id"))
    known = refs.join(facts.select("company_id", "fact_id", "quality"), ["company_id", "fact_id"]).groupBy("company_id", "milestone_id").agg(F.collect_set("fact_id").alias("known"), F.bool_and(F.col("quality").isin(*WEAK)).alias("weak"))
    rows = drafts.join(known, ["company_id", "milestone_id"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    both = F.array_intersect("supporting", "contradicting")
    rows = rows.withColumn("both", both).withColumn("s", F.array_except(F.array_intersect("supporting", "known"), "both")).withColumn("c", F.array_except(F.array_intersect("contradicting", "known"), "both"))
    invalid = F.size(F.array_except(F.array_union("supporting", "contradicting"), "known")) > 0
    n_s, n_c, over = F.size("s"), F.size("c"), F.size("both") > 0
    none, limited = F.lit("no_evidence"), F.lit("limited_support")
    some = F.when(n_s + n_c == 0, none)
    status = (
        F.when(F.col("status") == "no_evidence", none)
        .when(over, some.otherwise(limited))
        .when((F.col("status") == "supported") & invalid, F.when(n_s == 0, none).otherwise(limited))
        .when((F.col("status") == "conflict") & invalid, F.when((n_s > 0) & (n_c > 0), "conflict").when(n_s + n_c > 0, limited).otherwise(none))
        .when((F.col("status") == "supported") & (n_s == 0), limited)
        .when((F.col("status") == "conflict") & ((n_s == 0) | (n_c == 0)), limited)
        .when((F.col("status") == "supported") & F.coalesce("weak", F.lit(False)), limited)
        .otherwise(F.col("status"))
    )
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("final", status)
    keep = lambda c: F.when(F.col("final") == "no_evidence", empty).otherwise(F.col(c))
    return rows.select("company_id", "milestone_id", F.col("final").alias("status"), F.array_sort(keep("s")).alias("supporting"), F.array_sort(keep("c")).alias("contradicting"), (F.col("final") != F.col("status")).alias("downgraded"))


def complete_milestones(registry: DataFrame, observed: DataFrame, companies: DataFrame) -> DataFrame:
    """Every registered milestone of every company; those not observed have no evidence."""
    whole = companies.select("company_id").crossJoin(F.broadcast(registry.select("milestone_id")))  # the registry is a file of a few rows
    return whole.join(observed, ["company_id", "milestone_id"], "full").withColumn("status", F.coalesce("status", F.lit("no_evidence")))


# --- finance mapping ---------------------------------------------------------


def map_finance(rules: DataFrame, milestones: DataFrame, facts: DataFrame) -> DataFrame:
    """Rules (rule_id, template_id?, milestone_ids[], dimensions[]?, output) that apply to a company: all supported
    milestones and finance facts they name, and their strength."""
    ms = rules.withColumn("milestone_id", F.explode_outer("milestone_ids")).join(milestones, "milestone_id").where("template_id is null or template_id = milestone_template")
    tech = ms.where("status = 'supported'").groupBy("company_id", "rule_id").agg(F.array_sort(F.collect_set("milestone_id")).alias("milestones"))
    worst = ms.groupBy("company_id", "rule_id").agg(F.max(F.when(F.col("status") == "conflict", 3).when(F.col("status") == "limited_support", 2).when(F.col("status") == "no_evidence", 1).otherwise(0)).alias("worst"))
    wanted = rules.withColumn("dimension", F.explode_outer("dimensions")).select("rule_id", "dimension")
    named = facts.join(wanted.where("dimension is not null"), "dimension").select("company_id", "rule_id", "fact_id", "quality")
    every = facts.crossJoin(F.broadcast(wanted.where("dimension is null").select("rule_id"))).select("company_id", "rule_id", "fact_id", "quality")  # rules without dimensions take all
    fin = named.unionByName(every).groupBy("company_id", "rule_id").agg(F.array_sort(F.collect_set("fact_id")).alias("facts"), F.bool_and(F.col("quality").isin(*WEAK)).alias("weak"))
    out = tech.join(fin, ["company_id", "rule_id"], "full").join(worst, ["company_id", "rule_id"], "left").join(rules.select("rule_id", "output", F.size("milestone_ids").alias("n_milestones")), "rule_id")
    out = out.where((F.col("n_milestones") == 0) | (F.size(F.coalesce("milestones", F.array().cast("array<string>"))) > 0))
    strength = F.when(F.col("worst") == 3, "conflict").when((F.col("worst") == 2) | F.coalesce("weak", F.lit(False)), "limited_support").when(F.col("facts").isNull() | (F.col("worst") == 1), "insufficient_evidence").otherwise("supported")
    return out.withColumn("strength", strength).select("company_id", "rule_id", "output", "milestones", "facts", "strength")


def funding_gaps(mapped: DataFrame, dimensions: DataFrame, facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Due-diligence dimensions of which a company has no fact."""
    return companies.select("company_id").crossJoin(F.broadcast(dimensions.select("dimension"))).join(facts.select("company_id", "dimension"), ["company_id", "dimension"], "left_anti")


# --- official websites -------------------------------------------------------

WINDOW = 240
STRONG, WEAK_MARKS = ("official website", "official site"), ("website", "homepage", "visit us")
_HOST = re.compile(r"(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})", re.I)


def attested_hosts(pages: DataFrame) -> DataFrame:
    """(company_id, host, kind) of hosts that a page's text names near the company's name and a website mark: candidate
    if the mark is strong and the page is of that host, else an external hint."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                low = (r.text or "").lower()
                for m in _HOST.finditer(low):
                    around = low[max(0, m.start() - WINDOW) : m.end() + WINDOW]
                    if (r.name or "").lower() in around and any(w in around for w in STRONG + WEAK_MARKS):
                        host = m[1].removeprefix("www.")
                        own = r.host == host or (r.host or "").endswith("." + host)
                        out.append((r.company_id, host, "candidate" if own and any(w in around for w in STRONG) else "hint"))
            yield pd.DataFrame(out, columns=["company_id", "host", "kind"])

    return pages.select("company_id", "name", "host", "text").mapInPandas(run, "company_id string, host string, kind string").distinct()


def website(hosts: DataFrame) -> DataFrame:
    """One candidate host is accepted; several are a conflict."""
    c = hosts.groupBy("company_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "candidate", F.col("host")))).alias("candidates"), F.array_sort(F.collect_set(F.when(F.col("kind") == "hint", F.col("host")))).alias("hints"))
    status = F.when(F.size("candidates") == 1, "verified").when(F.size("candidates") > 1, "conflict").otherwise("unknown")
    return c.withColumn("status", status).withColumn("website", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))))
