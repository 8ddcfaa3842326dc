"""Knowledge base, references, gates, profiles and evaluation on small tables, against what they are defined to give."""

from __future__ import annotations

import datetime as dt
import random
import unicodedata

import duckdb
import pandas as pd
import pytest
from attestor.functions import text as t
from attestor.functions.unicode import locate
from attestor.operators import context, evaluation, knowledge, profiles, references, retrieval, rules
from attestor.plans import catalog
from pyspark.sql import functions as F


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


# --- functions ---------------------------------------------------------------

STRANGE = ["ＡＢ１２ ﬁne", "Straße É", "éclair", "ㄱ가 ㎏ ½", "İstanbul ΑΣ", "𝔘nicode ①", "电池技术Ａ", "", "a　b", None]


def test_folding_is_that_of_unicode(spark):
    for x, y in zip(STRANGE, values(spark, STRANGE, t.fold), strict=True):
        assert y == (None if x is None else unicodedata.normalize("NFKC", x).casefold())
    assert values(spark, ["Ａ  ﬁ"], t.identity_text) == ["A fi"]
    assert values(spark, ["《Ａ，b》。", "x. (y) "], t.edge_key) == ["a,b", "x. (y"]
    assert values(spark, ["A，b；c!"], t.claim_key) == ["a b c"]


def test_terms_of_wide_forms(spark):
    assert values(spark, ["ＡＢ１２ ﬁne", "电池技术 x电", "Große", "电a池子"], t.terms) == [["ab12", "fine"], ["电池", "池技", "技术", "x", "电"], ["grosse"], ["电", "a", "池子"]]
    texts = [x for x in STRANGE if x is not None] + ["电池技术 x电 abc", "电"]
    assert values(spark, texts, t.term_count) == [len(x) for x in values(spark, texts, t.terms)]


def test_sentences_and_clauses(spark):
    assert values(spark, ["Up 3.5 percent; more! Is it? 是。不是；\nend"], t.sentences) == [["Up 3.5 percent; more!", "Is it?", "是。", "不是；", "end"]]
    assert values(spark, ["a. b；c。d?"], t.clauses) == [["a. b", "c", "d?"]]


def test_python_rounding(spark):
    rnd = random.Random(1)
    xs = [2.675, 0.5, 1.5, 2.5, -2.675, 1.005, 0.125, 0.375, -0.125, 1e15, 0.0] + [round(rnd.uniform(-100, 100), 3) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(xs)), "i long, x double").select("i", t.python_round(F.col("x"), 2).alias("y"), t.python_round(F.col("x"), 0).alias("z")).collect()
    assert [r["y"] for r in sorted(rows, key=lambda r: r["i"])] == [round(x, 2) for x in xs]
    assert [r["z"] for r in sorted(rows, key=lambda r: r["i"])] == [float(round(x)) for x in xs]


def test_codes_and_times(spark):
    assert values(spark, [" e1 ", "E0", "F1", "E12", "E1x"], lambda x: t.safe_ref(x, "E")) == ["E1", None, None, "E12", None]
    assert values(spark, ["91350100m000100y43", "9135010OM000100Y43", "913"], t.credit_code) == ["91350100M000100Y43", None, None]
    got = values(spark, ["2024-05-01", "2024-05-01T10:00:00", "2024-05-01T10:00:00+02:00", "2024-13-01", "soon"], lambda x: t.iso_time(x).cast("string"))
    assert got == ["2024-05-01 00:00:00", "2024-05-01 10:00:00", "2024-05-01 08:00:00", None, None]


def test_quotes_are_located(spark):
    text = "x ① ﬁ  ＢC　d"
    rows = spark.createDataFrame([(text, "1 FI bc D"), (text, "fi"), (text, "none"), (None, "x"), (text, None)], "t string, q string").select(locate("t", "q").alias("l")).collect()
    assert [tuple(r["l"]) for r in rows] == [(2, len(text)), (4, 5), (-1, -1), (-1, -1), (-1, -1)]


# --- retrieval and context ---------------------------------------------------


def test_cosine_in_blocks(spark):
    import numpy as np

    rnd = np.random.default_rng(2)
    v, q = rnd.normal(size=(70, 5)), rnd.normal(size=(9, 5))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    score = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 6)
    want = {(i, int(d), k) for i in range(9) for k, d in enumerate(sorted(range(70), key=lambda d: (-score[i, d], d))[:4], 1)}
    for block in (4, 100):
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.cosine(docs, queries, 4, block).collect()} == want
    assert retrieval.cosine(docs, queries.limit(0), 4).count() == 0 and retrieval.cosine(docs.limit(0), queries, 4).count() == 0


def test_balanced_context_keeps_every_group():
    # of eight ranked rows the third and later are queued by group; the second group's rows aren't lost
    groups = [{0}, {0}, {0}, {0}, {0}, {0}, {1}, {1}]
    assert context.balanced(groups, 8) == [0, 1, 2, 3, 4, 6, 5, 7]
    assert context.balanced(groups, 2) == [0, 2, 6, 3, 7, 4, 5]  # a lead of one: the second strongest is in no queue
    assert context.balanced([{1, 2}, {2}, {2, 1}, {0}], 4) == [0, 1, 3, 2]


def test_context_audit(spark):
    rows = [(1, d, g, f"Own {d}! Shared!", float(s)) for d, g, s in [(1, 0, 9), (1, 1, 9), (2, 1, 8), (3, 0, 7), (4, 0, 6), (5, 1, 5)]]
    frame = spark.createDataFrame(rows, "case_id long, doc_id long, query_group int, text string, score double")
    done = context.assemble(frame, chunks=4, chars=31)
    got = {r["doc_id"]: (r["excerpt"], r["outcome"], r["groups"]) for r in done.collect()}
    assert got[1] == ("Own 1!Shared!", "selected", "0,1") and got[2] == ("Own 2!", "selected", "1") and got[3][:2] == ("Own 3!", "selected") and got[4][1] == "max_chunks" and got[5][0] == "Own 5!"
    audit = context.audit(frame, done).collect()[0]
    assert (audit["n_candidates"], audit["n_repeated_hits"], audit["n_selected"], audit["n_max_chunks"], audit["n_characters"], audit["selected_by_group"]) == (5, 1, 4, 1, 31, "0:2,1:3")
    frame = pd.DataFrame({"doc_id": [1, 2], "query_group": [0, 0], "text": ["a" * 30, "b" * 5], "score": [2.0, 1.0]})
    assert [r["outcome"] for r in context.choose(frame, False, 8, 10)] == ["character_budget", "selected"]


# --- knowledge base ----------------------------------------------------------


def test_vector_upserts(spark):
    index = spark.createDataFrame([("t:d:c1", "c1", 3, [0.0]), ("t:d:c9", "c9", 1, [9.0])], "storage_id string, chunk_id string, page int, vector array<double>")
    chunks = spark.createDataFrame([("t", "d", "c1", None), ("t", "d", "c2", 2)], "task_id string, document_id string, chunk_id string, page int")
    vectors = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0])], "chunk_id string, vector array<double>")
    got = {r["storage_id"]: (r["page"], r["vector"]) for r in knowledge.upsert_vectors(index, chunks, vectors).collect()}
    assert got == {"t:d:c1": (-1, [1.0]), "t:d:c2": (2, [2.0]), "t:d:c9": (1, [9.0])}
    with pytest.raises(Exception, match="no vector for t:d:c2"):
        knowledge.upsert_vectors(index, chunks, vectors.limit(1)).collect()
    rows = spark.createDataFrame([("v1", "b"), ("v1", "a"), ("v2", "c")], "source_version_id string, chunk_id string")
    assert [r["chunk_id"] for r in knowledge.chunks_of_version(rows, "v1").collect()] == ["a", "b"]


# --- references --------------------------------------------------------------


def test_bindings_and_classification(spark):
    bound = references.bound_fields(spark.createDataFrame([("E1", ["b", "a"]), ("E1", ["a"]), ("E2", [])], "evidence_id string, supports array<string>"))
    assert [tuple(r) for r in bound.collect()] == [("E1", ["a", "b"])]
    evidence = spark.createDataFrame([(1, "E1", "k1"), (1, "E2", "k2"), (2, "E1", "k3")], "company_id long, ref string, chunk_id string")
    drafts = spark.createDataFrame(
        [(1, "classified", ["d1", "x"], [" e2", "E2", "E9"], [("t1", ["E1"]), ("t2", ["E7"])]), (2, "classified", ["d1"], ["E5"], []), (3, "unknown", [], [], [("t1", ["E1"])])],
        "company_id long, status string, domains array<string>, domain_refs array<string>, templates array<struct<template_id: string, refs: array<string>>>",
    )
    got = {r["company_id"]: r for r in references.classified(drafts, evidence, ["d1"]).collect()}
    assert got[1]["domain_chunks"] == ["k2"] and [x["template_id"] for x in got[1]["templates"]] == ["t1"] and got[1]["n_dropped"] == 1 and got[1]["unknown_domains"] == ["x"]
    assert got[2]["status"] == "insufficient_evidence" and got[2]["domains"] == [] and got[2]["downgraded"]
    assert got[3]["status"] == "unknown" and got[3]["n_dropped"] == 1


def test_sets_in_order(spark):
    rows = spark.createDataFrame([(1, 0, "A"), (1, 1, "a "), (1, 2, "b"), (2, 0, "a")], "g long, at int, x string")
    first = references.stable_distinct(rows, ["g"], t.normal_key(F.col("x")), "at")
    assert sorted(tuple(r) for r in first.collect()) == [(1, 0, "A"), (1, 2, "b"), (2, 0, "a")]
    assert (1, 1, "a ") in {tuple(r) for r in references.stable_distinct(rows, ["g"], t.normal_key(F.col("x")), "at", last=True).collect()}
    assert references.ordered_union(rows, rows.limit(1)).where("part = 1").count() == 1
    asked = spark.createDataFrame([(0, "plants"), (1, "ＡCME  plants"), (2, " "), (3, "Patents of Acme")], "at int, query string")
    done = spark.createDataFrame([("patents OF acme",)], "query string")
    assert [tuple(r) for r in references.fresh_queries(asked, done, company="Acme").orderBy("at").collect()] == [(0, "Acme plants")]
    assert [r["at"] for r in references.fresh_queries(asked, done, known_terms=["plants", "none"]).orderBy("at").collect()] == [0, 1]


def test_first_matches(spark):
    rows = spark.createDataFrame([(1, 0, "计划量产电池。"), (1, 1, "尚未完成；已量产电池"), (1, 2, "量产"), (2, 0, "量产未完成")], "g long, at int, text string")
    assert [tuple(r) for r in references.first_match(rows, "g", "at", ["量产"]).orderBy("g").collect()] == [(1, 0, "计划量产电池。"), (2, 0, "量产未完成")]
    assert [tuple(r) for r in references.first_affirmed(rows, "g", "at", ["量产"]).collect()] == [(1, 1, "尚未完成；已量产电池")]
    assert references.first_affirmed(rows, "g", "at", ["量产"], ["专利"]).count() == 0
    reasons = spark.createDataFrame([("证据不能证明其具有领先优势", "领先"), ("具有领先优势，不能证明", "领先"), ("无关", "领先"), ("不支持" + "远" * 20 + "领先", "领先")], "r string, m string")
    assert [r[0] for r in reasons.select(references.taken_back(F.col("r"), F.col("m"))).collect()] == [True, False, False, False]
    pages = spark.createDataFrame([("u1", "The Ｐlant opened"), ("u2", "in 2024.")], "canonical string, content string")
    claims = spark.createDataFrame([(1, "plant OPENED", ["u1"]), (2, "opened in 2024", ["u1", "u2"]), (3, "closed", ["u1"]), (4, "plant", ["u9"]), (5, "", ["u1"])], "claim_id long, quote string, urls array<string>")
    assert {r["claim_id"]: r["found"] for r in references.claims_in_pages(claims, pages).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    gaps = spark.createDataFrame([(1, 0, "no revenue"), (1, 1, "model_call failed"), (1, 2, "no revenue")], "c long, at int, gap string")
    assert [tuple(r) for r in references.reader_gaps(gaps, "c", "at").collect()] == [(1, "no revenue", 0)]


def test_subjects(spark):
    facts = spark.createDataFrame([(1, "本公司"), (1, "ＡCME"), (1, "Other"), (2, "Acme"), (1, None)], "company_id long, subject string")
    names = spark.createDataFrame([(1, "Acme")], "company_id long, name string")
    assert sorted((r["company_id"], r["subject"]) for r in references.canonical_subject(facts, names).collect()) == [(1, ""), (1, "__company__"), (1, "__company__"), (1, "other"), (2, "acme")]


# --- profiles ----------------------------------------------------------------


def test_chain_of_profiles(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    companies = spark.createDataFrame([(i,) for i in range(1, 7)], "company_id long")
    tech = spark.createDataFrame([("t1", 1, d(1)), ("t1b", 1, d(2)), ("t3", 3, d(1)), ("t4", 4, d(1)), ("t5", 5, d(1)), ("t6", 6, d(1))], "profile_id string, company_id long, updated_at timestamp")
    fin = spark.createDataFrame([("f1", 1, d(3), "t1b"), ("f1n", 1, d(9), "t1"), ("f4", 4, d(1), "old"), ("f5", 5, d(1), "t5"), ("f6", 6, d(1), "t6")], "profile_id string, company_id long, updated_at timestamp, technology_profile_id string")
    ass = spark.createDataFrame([("a1", 1, d(4), "t1b", "f1"), ("a6", 6, d(4), "t6", "f0")], "profile_id string, company_id long, updated_at timestamp, technology_profile_id string, finance_profile_id string")
    got = {r["company_id"]: r["state"] for r in profiles.chain(companies, tech, fin, ass).collect()}
    assert got == {1: "ok", 2: "missing_technology_profile", 3: "missing_finance_profile", 4: "stale_profile_chain", 5: "missing_assertion_profile", 6: "stale_profile_chain"}


def test_identity_and_observation_checks(spark):
    base = spark.createDataFrame([("web", None, "https://a.com/x", "h1")], "source_type string, external_id string, canonical_url string, content_sha256 string")
    good = base.withColumn("source_id", t.source_id(F.col("source_type"), F.col("external_id"), F.col("canonical_url"), F.col("content_sha256"))).withColumn("source_version_id", t.version_id(F.col("source_id"), F.col("content_sha256")))
    versions = good.select("source_version_id", "source_id", "content_sha256")
    chunks = versions.select("source_version_id", "source_id", F.lit("k1").alias("chunk_id"))
    assert profiles.identity_violations(good.drop("source_version_id", "content_sha256"), versions, chunks).count() == 0
    bad = profiles.identity_violations(good.drop("source_version_id", "content_sha256").withColumn("source_id", F.lit("src_x")), versions.withColumn("source_version_id", F.lit("sv_x")), chunks.union(chunks))
    assert {r["check"] for r in bad.collect()} == {"source_id", "source_version_id", "chunk_version", "chunk_id"}
    schema = "observation_id string, kind string, status string, technology_fact_ids array<string>, milestone_refs array<string>, rule_ids array<string>"
    seen = spark.createDataFrame([("o1", "risk", "supported", ["f1"], ["m1"], ["r1"]), ("o2", "funding", "limited", ["f1"], ["m2"], ["r1"]), ("o3", "risk", "x", ["f9"], ["m9"], ["r9"]), ("o4", "risk", "supported", [], ["m1"], ["r2"])], schema)
    milestones = spark.createDataFrame([("m1", "supported", ["f1"]), ("m2", "conflict", ["f1"])], "ref string, status string, fact_ids array<string>")
    rules = spark.createDataFrame([("r1", ["m1", "m2"]), ("r2", [])], "rule_id string, milestones array<string>")
    facts = spark.createDataFrame([("f1",)], "fact_id string")
    assert {tuple(r) for r in profiles.observation_violations(seen, milestones, facts, rules).collect()} == {
        ("milestone_not_supported", "o2"), ("unknown_fact", "o3"), ("unknown_rule", "o3"), ("unknown_milestone", "o3"), ("milestone_without_rule", "o3"), ("milestone_without_rule", "o4"), ("milestone_facts_missing", "o4"),
    }


def test_output_contract_and_draft_checks(spark):
    outputs = spark.createDataFrame([("c1", "see [E1] and [E9]", [("technical_maturity", 50.0, ["E1"]), ("x", 1.0, [])]), ("c2", "[E1]", [("technical_maturity", 20.0, ["E1"])])], "case_id string, payload string, indicators array<struct<name: string, score: double, evidence: array<string>>>")
    evidence = spark.createDataFrame([("c1", "E1", "公司计划量产"), ("c2", "E1", "公司计划量产")], "case_id string, evidence_id string, excerpt string")
    assert {tuple(r) for r in profiles.output_violations(outputs, evidence).collect()} == {("invalid_reference", "c1:E9"), ("indicator_without_evidence", "c1:x"), ("over_inferred", "c1")}
    rows = spark.createDataFrame([(1, "supported", [], ["a"], ["a"], []), (2, "no_evidence", ["e"], ["a"], ["b"], ["p"]), (3, "supported", ["e"], [], [], ["p"])], "id long, status string, evidence_ids array<string>, primary array<string>, secondary array<string>, plan array<string>")
    assert {tuple(r) for r in profiles.contract_violations(rows, "id").collect()} == {("classified_without_evidence", "1"), ("label_overlap", "1"), ("empty_plan", "1"), ("evidence_without_status", "2")}
    drafts = spark.createDataFrame([(1, "resolved", "91350100M000100Y43", ["https://a.com/"], []), (2, "resolved", "x", [], []), (3, "ambiguous", None, ["https://b.com"], ["only"])], "company_id long, status string, code string, urls array<string>, candidates array<string>")
    pages = spark.createDataFrame([("https://a.com",)], "canonical string")
    assert {tuple(r) for r in profiles.identity_drafts(drafts, pages).collect()} == {("no_evidence_url", "2"), ("credit_code", "2"), ("too_few_candidates", "3"), ("unknown_url", "3")}


# --- evaluation --------------------------------------------------------------


def test_anchors_and_packets(spark):
    pages = spark.createDataFrame([(1, 1, "Ａ new  plant opened"), (1, 2, None)], "doc_id long, page int, text string")
    quotes = spark.createDataFrame([("q1", 1, 1, "a NEW plant"), ("q2", 1, 1, "closed"), ("q3", 1, 9, "x")], "quote_id string, doc_id long, page int, quote string")
    got = {r["quote_id"]: r for r in evaluation.anchors(quotes, pages).collect()}
    assert (got["q1"]["start"], got["q1"]["end"]) == (0, 12) and got["q1"]["anchor_id"].startswith("anc_") and got["q2"]["reason"] == "quote_not_found" and got["q3"]["reason"] == "page_missing"
    chunks = spark.createDataFrame([("k2", 1, 1, "a NEW plant b"), ("k1", 1, 1, "other"), ("k3", 1, 1, "a NEW plant")], "chunk_id string, doc_id long, page int, text string")
    ranked = spark.createDataFrame([("q1", "bm25", "k3", 1), ("q1", "bm25", "k1", 2), ("q1", "bm25", "k2", 3), ("q1", "rrf", "k9", 1)], "quote_id string, method string, chunk_id string, rank int")
    packet = {r["quote_id"]: r for r in evaluation.review_packet(quotes, chunks, ranked).collect()}
    assert packet["q1"]["first_chunk"] == "k2" and packet["q1"]["candidates"] == {"bm25": ["k3", "k1"]} and packet["q2"]["first_chunk"] is None
    required = spark.createDataFrame([(1, "c", 1, ["new plant", "open ed"]), (2, "c", 2, ["new"]), (3, "c", 1, ["shut"])], "required_id long, case_id string, page int, phrases array<string>")
    refs = spark.createDataFrame([("c", 1, "A new\nplant opened")], "case_id string, page int, excerpt string")
    assert {r["required_id"]: r["hit"] for r in evaluation.evidence_hits(required, refs).collect()} == {1: True, 2: False, 3: False}


def test_methods_and_rates(spark):
    ranked = spark.createDataFrame([("A", 1, 10, 1), ("A", 1, 11, 4), ("B", 1, 11, 2), ("B", 2, 20, 1)], "method string, query_id long, doc_id long, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["method"]: tuple(r)[1:] for r in evaluation.compare_methods(ranked, relevant, queries).collect()}
    assert got == {"A": (2, 0.25, 0.5, 0.5, 0.5, 0.5), "B": (2, 0.75, 0.75, 0.75, 0.75, 1.0)}
    with_page = ranked.where("method = 'A'").withColumn("page", F.lit(1))
    assert [tuple(r) for r in evaluation.page_recall(with_page, relevant.withColumn("page", F.lit(1)), 3).orderBy("query_id").collect()] == [(1, 0.5), (2, 0.0)]
    rows = spark.createDataFrame([("c", 50.0, 52.0, 1, ["e1"]), ("c", 50.0, 60.0, 1, ["e9"]), ("c", None, None, 0, []), ("c", 10.0, 10.0, 0, [])], "case_id string, gold double, score double, n_evidence int, evidence_ids array<string>")
    assert tuple(evaluation.match_rates(rows, ["case_id"], 5.0).first()) == ("c", 75.0, 25.0)
    assert tuple(evaluation.evidence_completeness(rows, spark.createDataFrame([("c", "e1")], "case_id string, evidence_id string"), "case_id").first()) == ("c", 0.3333)
    assert tuple(evaluation.mapping_coverage(rows, "case_id").first()) == ("c", 0.5)
    runs = evaluation.all_runs(spark.createDataFrame([("c1",), ("c2",)], "case_id string"), ["rule", "llm"], 2, spark.createDataFrame([("c1", "llm", 2, "failed")], "case_id string, mode string, run int, status string"))
    assert runs.count() == 8 and runs.where("status = 'failed'").count() == 1 and runs.where("status = 'not_run'").count() == 7
    batches = spark.createDataFrame([("a", 3, None), ("a", 2, "timeout"), ("b", 1, None)], "job string, n_chunks int, error string")
    assert {r["job"]: (r["n_batches"], r["n_ok"], r["n_chunks"], r["errors"]) for r in evaluation.batch_report(batches, "job").collect()} == {"a": (2, 1, 5, {"timeout": 1}), "b": (1, 1, 1, None)}
    summary = evaluation.review_summary(spark.range(50).selectExpr("id", "if(id % 2 = 0, 'ok', 'bad') status"), "status", 3)
    assert {r["status"]: (r["n"], r["first_ids"]) for r in summary.collect()} == {"ok": (25, [0, 2, 4]), "bad": (25, [1, 3, 5])}
    both = spark.createDataFrame([("legacy", 1, "a b"), ("balanced", 1, "a b c"), ("balanced", 1, None)], "strategy string, case_id long, excerpt string")
    asked = spark.createDataFrame([(1, 1, "b c"), (1, 2, "a")], "case_id long, quote_id long, quote string")
    assert {r["strategy"]: (r["n_quotes"], r["n_whole"]) for r in evaluation.replay(both, asked).collect()} == {"legacy": (2, 1), "balanced": (2, 2)}


# --- queries on tables made for them -----------------------------------------


def like_sql(spark, folder, name, table, rows):
    """A query's rows on one small table, compared with its SQL."""
    frame = pd.DataFrame(rows)
    frame.to_parquet(folder / f"{table}.parquet")
    con = duckdb.connect()
    con.register(table, frame)
    result = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)
    return got


def test_a_proven_page_proves_no_other_page_of_its_url(spark, tmp_path):
    got = like_sql(spark, tmp_path, "relevance_gate", "pages", [{"page_id": i, "url": "http://a.example.com/x", "html": f"<p>text of page {i}, long enough to be quoted from it</p>"} for i in range(1, 13)])
    assert [r["page_id"] for r in got if r["origin"] == "identity_evidence"] == [11]


def test_proofs_of_a_url_hold_for_all_its_pages(spark):
    pages = spark.createDataFrame([(1, "u", "h", "text"), (2, "u", "h", "text")], "page_id long, canonical string, host string, content string")
    none = spark.createDataFrame([], "page_id long, status string, quote string")
    proven = lambda **by: sorted(r["page_id"] for r in references.relevance(pages, none, pages.where("page_id = 1"), F.lit("o"), **by).where("origin = 'identity_evidence'").collect())
    assert proven() == [1, 2] and proven(by="page_id") == [1]


def test_keyword_rules_are_those_of_their_sql(spark, tmp_path):
    texts = ["Licensed under MIT. It was never sold.", "it is not licensed", "Licensed；never", "never", "a\nlicensed", "", None]
    got = like_sql(spark, tmp_path, "keyword_rules_scores", "documents", [{"doc_id": i, "text": x, "lang": "en", "source": "src0"} for i, x in enumerate(texts)])
    assert {r["doc_id"]: r["licensed_clause"] for r in got} == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: None}


def test_negations_hold_within_their_clause(spark):
    texts = ["Licensed. Never sold", "it is not licensed", "licensed；never", "never", None]
    assert values(spark, texts, lambda x: rules.affirmed(x, ["licensed"], ["not licensed", "never"])) == [False, False, True, False, None]
