"""Operators of the reference: goldens, edge cases, and each registered query against its DuckDB oracle."""

from __future__ import annotations

import duckdb
import pytest
from attestor.functions import text as t
from attestor.functions.unicode import locate, nfkc_fold
from attestor.operators import chunking, claims, context, extract, indicators, research, retrieval, rules, scoring, selection, versions
from attestor.plans import catalog
from attestor.sources import readers, sinks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
W = [("autonomy", "technology", 0.25), ("innovation", "technology", 0.30), ("protection", "protection", 0.20), ("maturity", "maturity", 0.25)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def shown(rows, columns):
    def cell(v):
        if isinstance(v, float):
            return "null" if v != v else repr(round(v, 6))
        return "null" if v is None else str(v)

    return sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert shown([r.asDict() for r in got.collect()], columns) == shown([dict(zip(columns, r, strict=True)) for r in result.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() > 0


# --- goldens -----------------------------------------------------------------


@pytest.mark.parametrize(("scores", "total"), [((80, 85, 80, 85), 82.75), ((None, None, None, None), None), ((None, 55, None, 25), 41.36)])
def test_weighted_goldens(spark, scores, total):
    long = spark.createDataFrame([("e", i, None if s is None else float(s)) for (i, _, _), s in zip(W, scores, strict=True)], "entity_id string, indicator string, score double")
    rows = {r["dimension"]: r for r in scoring.evaluate(long, spark.createDataFrame(W, "indicator string, dimension string, weight double")).collect()}
    assert rows[None]["score"] == total
    assert rows[None]["status"] == ("insufficient_evidence" if total is None else "fully_scored" if None not in scores else "partially_scored")
    if scores[0] == 80:
        assert [rows[d]["score"] for d in ("technology", "protection", "maturity")] == [82.73, 80.0, 85.0]


@pytest.mark.parametrize(("tech", "ind", "overall"), [(82.75, 73.75, 79.15), (78.25, 24.5, 56.75), (39.38, 73.75, 53.13), (None, 70.0, None)])
def test_composite_goldens(spark, tech, ind, overall):
    got = one(spark, scoring.composite(F.lit(tech).cast("double"), F.lit(ind).cast("double")))
    assert got == overall


def test_weights_are_checked(spark):
    good = spark.createDataFrame(W, "indicator string, dimension string, weight double")
    assert scoring.check_weights(good).count() == 0
    assert {r["check"] for r in scoring.check_weights(good.union(good.limit(1))).collect()} == {"sum", "duplicate"}


# --- text --------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, t.terms(F.lit("Ab12 电池技术 x 电"))) == ["ab12", "电池", "池技", "技术", "x", "电"]
    assert one(spark, t.normal_key(F.lit("  Straße \n A "))) == "strasse a"
    assert one(spark, t.canonical_url(F.lit("HTTPS://WWW.Example.com:443/a/?b=1#c"))) == "https://www.example.com/a?b=1"
    assert one(spark, t.canonical_url(F.lit("ftp://x"))) is None and one(spark, t.canonical_url(F.lit("http://u:p@x.com/"))) is None
    assert one(spark, t.host_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]
    assert one(spark, t.contains_phrase(F.lit("the pilot line"), F.lit("pilot"))) and not one(spark, t.contains_phrase(F.lit("copilots"), F.lit("pilot")))
    assert one(spark, t.redact(F.lit("Bearer abc.def tvly-12345678 x"))) == "[redacted] [redacted] x"
    assert one(spark, t.char_grams(F.lit("abcabc"), 3)) == ["abc", "bca", "cab"] and one(spark, t.char_grams(F.lit("ab"), 3)) == ["ab"]
    for raw, form in (("2024年 Q3", "2024-Q3"), ("2023h1", "2023-H1"), ("2023年下半年", "2023-H2"), ("2024年第三季度", "2024-Q3"), ("FY 2022", "2022"), ("2022年度", "2022"), ("H1 2023", "h1 2023"), ("2024 q3 plan revised", "2024 q3 plan revised"), ("soon", "soon")):
        assert one(spark, t.normal_period(F.lit(raw))) == form
    assert tuple(one(spark, t.amount(F.lit(10.0), F.lit("亿元"), F.lit(None).cast("string")))) == (1e9, "CNY")
    assert tuple(one(spark, t.amount(F.lit(10.0), F.lit("亿元"), F.lit("USD")))) == (10.0, "亿元")
    assert one(spark, t.company_id(F.lit(" ACME  Co"))) == one(spark, t.company_id(F.lit("acme co")))
    assert one(spark, nfkc_fold(F.lit("ＡＢ ﬁ"))) == "ab fi"
    assert tuple(one(spark, locate(F.lit("a  ＢC d"), F.lit("bc D")))) == (3, 7)


def test_chunks_cover_and_overlap():
    text = "".join(f"Sentence {i}. " for i in range(200))
    pieces = chunking.page_pieces(text)
    assert all(len(p) <= 520 for p in pieces) and pieces[0].startswith("Sentence 0") and pieces[-1].endswith("199.")
    assert all(f"Sentence {i}." in " ".join(pieces) for i in range(200))
    with pytest.raises(ValueError, match="overlap"):
        chunking.page_pieces("x", 10, 10)
    web = chunking.web_pieces("# H\n\none two.\n\n## K\n\n" + "word. " * 600)
    assert web[0][0] == "H" and {w[0] for w in web[1:]} == {"K"} and all(len(w[2]) <= 1400 for w in web)


# --- retrieval ---------------------------------------------------------------


def test_bm25_ranks_the_matching_text_first(spark):
    docs = spark.createDataFrame([(0, "battery cell plant"), (1, "patent office grants"), (2, "nothing here")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "battery"), (1, "patent patent"), (2, "absent")], "query_id long, text string")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.bm25(docs, queries).collect()}
    assert got == {(0, 1): 0, (1, 1): 1}


def test_embeddings_are_unit_vectors(spark):
    v = spark.createDataFrame([("abc def",), ("",)], "text string").select(retrieval.embed_column(F.col("text"), 128).alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1, abs=1e-5) and not any(v[1]["v"])


def test_context_budget():
    import pandas as pd

    frame = pd.DataFrame({"doc_id": range(12), "query_group": [i % 3 for i in range(12)], "text": [f"Sentence {i}! Shared end!" for i in range(12)], "score": [12.0 - i for i in range(12)]})
    out = context.choose(frame, chunks=4, chars=60)
    picked = [r for r in out if r["outcome"] == "selected"]
    assert sum(len(r["excerpt"]) for r in picked) <= 60 and len(picked) <= 4
    assert "".join(r["excerpt"] for r in picked).count("Shared end!") == 1


# --- selection, claims, rules ------------------------------------------------


def test_selection_takes_turns():
    import pandas as pd

    rows = [(s, i, f"{s}{i} " * 40, k) for k, (s, i) in enumerate((s, i) for s in "abc" for i in range(4))]
    out = selection.select_rounds(pd.DataFrame(rows, columns=["source", "item", "text", "rank"]), selection.Budget(chunks=5))
    chosen = out[out.outcome == "selected"].sort_values("place").source.tolist()
    assert chosen == ["a", "b", "c", "a", "b"] and (out.outcome == "source_cap").sum() == 6
    twice = pd.DataFrame([("a", 0, "same text " * 20, 0), ("b", 1, "Same  text " * 20, 1)], columns=["source", "item", "text", "rank"])
    assert selection.select_rounds(twice).outcome.tolist() == ["selected", "near_duplicate"]
    scored = pd.DataFrame([("a", i, f"text {i} " * 30, i % 3, 0, i) for i in range(9)], columns=["source", "item", "text", "score", "quality", "rank"])
    assert selection.select_scored(scored).how.tolist().count("scored") == 3


def test_claims_guard_and_cluster(spark):
    assert claims.equivalent("Yield is 85%", "yield is 92%")[0] == "guard"
    assert claims.equivalent("Model ab-12 ships", "model ab-13 ships")[0] == "guard"
    assert claims.equivalent("The Plant opened", "the plant, opened")[0] == "exact"
    assert claims.equivalent("pilot line was finished", "the pilot line was finished early")[0] == "containment"
    facts = spark.createDataFrame([("s", i, x, "p", i) for i, x in enumerate(["plant opened in spring", "Plant opened in spring!", "battery was tested"])], "slot string, fact_id long, text string, predicate string, rank int")
    got = {r["fact_id"]: r["cluster"] for r in claims.cluster_slots(facts).collect()}
    assert got[0] == got[1] != got[2]


def test_clusters_are_those_of_the_plain_loop():
    """cluster() against a comparison of each claim with every anchor, on words that repeat, contain and guard each other."""
    import random

    import pandas as pd

    rnd = random.Random(5)
    words = ["aa", "aaaa", "plant", "yield", "12", "85%", "ab-12", "电池", "x", "the", "opened", "!", "é", "banana", "nanana"]
    methods = set()
    for _ in range(60):
        base = [rnd.choices(words[: rnd.choice([3, 8, 15])], k=rnd.randint(0, 12)) for _ in range(8)]
        texts = [" ".join([w for w in rnd.choice(base) if rnd.random() < 0.9] + rnd.choices(words, k=rnd.randint(0, 2))) for _ in range(rnd.randint(1, 40))]
        frame = pd.DataFrame({"fact_id": rnd.sample(range(1000), len(texts)), "text": texts, "predicate": rnd.choices(["p", "P", "q", None], k=len(texts)), "rank": rnd.choices([0, 1], k=len(texts))})
        anchors, expected = [], []
        for r in frame.sort_values(["rank", "fact_id"]).itertuples():
            said = [claims.equivalent(a.text, r.text, same_predicate=claims.claim_text(a.predicate) == claims.claim_text(r.predicate)) for a in anchors]
            hit = next(((i, m, s) for i, (m, s) in enumerate(said) if m not in (None, "guard")), None)
            if hit is None:
                hit = (len(anchors), "exact", 1.0)
                anchors.append(r)
            expected.append((r.fact_id, *hit))
        got = list(claims.cluster(frame).itertuples(index=False, name=None))
        assert got == expected
        methods |= {m for _, _, m, _ in got}
    assert methods == {"exact", "containment", "fuzzy_text"}


def test_a_full_slot_is_clustered_in_seconds():
    """4,000 unlike claims in one slot: each against every anchor were eight million comparisons."""
    import random
    import time

    import pandas as pd

    rnd = random.Random(1)
    texts = ["the " + "".join(rnd.choices("etaoinshr dlu ", weights=range(14, 0, -1), k=300)) for _ in range(4000)]
    start = time.monotonic()
    got = claims.cluster(pd.DataFrame({"fact_id": range(4000), "text": texts, "predicate": "p", "rank": 0}))
    assert got.cluster.nunique() == 4000 and time.monotonic() - start < 60


def test_first_sentence(spark):
    import random

    rnd = random.Random(2)
    texts = ["".join(rnd.choices(" \n!？ab。\t.", k=rnd.randint(0, 8))) for _ in range(2000)] + [None, "", "   ", " \n !", "!a b! c"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    differ = rows.where(~t.first_sentence(F.col("x")).eqNullSafe(F.try_element_at(t.sentences(F.col("x")), F.lit(1))))
    assert differ.collect() == []


def test_conflicts(spark):
    facts = spark.createDataFrame([("c", "u", 1.0, 1, "a", 0), ("c", "u", 2.0, 2, "b", 0), ("d", "u", 1.0, 3, "a", 0), ("d", "u", 1.0, 4, "b", 0)], "slot string, unit string, value double, fact_id long, source_id string, rank int")
    got = {(r["slot"], r["value"]): r["status"] for r in claims.assertions(facts, ["slot"]).collect()}
    assert got == {("c", 1.0): "conflict", ("c", 2.0): "conflict", ("d", 1.0): "multi_source_support"}


def test_milestone_guard(spark):
    facts = spark.createDataFrame([("c", "f1", "first_party"), ("c", "f2", "weak_web")], "company_id string, fact_id string, quality string")
    drafts = spark.createDataFrame(
        [("c", "m1", "supported", ["f1"], []), ("c", "m2", "supported", ["f2"], []), ("c", "m3", "supported", ["zz"], []), ("c", "m4", "conflict", ["f1"], ["f2"]), ("c", "m5", "supported", ["f1"], ["f1"]), ("c", "m6", "conflict", ["f1"], [])],
        "company_id string, milestone_id string, status string, supporting array<string>, contradicting array<string>",
    )
    got = {r["milestone_id"]: r["status"] for r in rules.guard_milestones(drafts, facts).collect()}
    assert got == {"m1": "supported", "m2": "limited_support", "m3": "no_evidence", "m4": "conflict", "m5": "no_evidence", "m6": "limited_support"}


def test_finance_rules(spark):
    rule = spark.createDataFrame([("r1", None, ["m1"], ["revenue"], "funding"), ("r2", None, ["m2"], None, "risk"), ("r3", None, [], ["debt"], "monitoring")], "rule_id string, template_id string, milestone_ids array<string>, dimensions array<string>, output string")
    ms = spark.createDataFrame([("c", "m1", "t", "supported"), ("c", "m2", "t", "no_evidence")], "company_id string, milestone_id string, milestone_template string, status string")
    facts = spark.createDataFrame([("c", "f1", "revenue", "first_party"), ("c", "f2", "debt", "weak_web")], "company_id string, fact_id string, dimension string, quality string")
    got = {r["rule_id"]: r["strength"] for r in rules.map_finance(rule, ms, facts).collect()}
    assert got == {"r1": "supported", "r3": "limited_support"}


def test_websites(spark):
    rows = [("c", "Acme", "acme.com", "Welcome to Acme, our official website is www.acme.com ."), ("d", "Beta", "news.org", "Beta has an official website beta.io now")]
    hosts = rules.attested_hosts(spark.createDataFrame(rows, "company_id string, name string, host string, text string"))
    got = {r["company_id"]: (r["status"], r["website"], r["hints"]) for r in rules.website(hosts).collect()}
    assert got == {"c": ("verified", "acme.com", []), "d": ("unknown", None, ["beta.io"])}


def test_indicators(spark):
    docs = spark.createDataFrame([(1, "We run mass production. Granted patent 1."), (2, "We plan mass production; a prototype exists."), (3, "nothing")], "doc_id long, text string")
    got = {(r["entity_id"], r["indicator"]): r["score"] for r in indicators.observe(docs, indicators.technology).collect()}
    assert got[1, "maturity"] == 85 and got[1, "protection"] == 80 and got[2, "maturity"] == 45 and got[3, "maturity"] is None
    assert indicators.observe(docs, indicators.industry).count() == 12


# --- versions, runs, files ---------------------------------------------------


def test_versions(spark):
    rows = [("s", "a", "2024-01-01", 1), ("s", "b", "2024-02-01", 2), ("s", "c", "2023-01-01", 3), ("s", "a", "2024-02-01", 4)]
    captures = spark.createDataFrame(rows, "source_id string, content_hash string, retrieved_at string, arrival long").withColumn("retrieved_at", F.to_timestamp("retrieved_at"))
    got = {r["content_hash"]: (r["is_current"], r["supersedes"]) for r in versions.rebuild(captures).collect()}
    assert got == {"a": (True, None), "b": (False, "a"), "c": (False, None)}


def test_model_calls(spark):
    def model(prompts):
        return ["```json\n{\"a\": 1}\n```" if "good" in p else "{\"a\": 2}" if "invalid_json" in p else "oops" for p in prompts]

    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "request_id string, prompt string")
    got = extract.call(rows, model, lambda v: None if "a" in v else "missing")
    assert {r["request_id"]: (r["payload"], r["attempts"]) for r in got.collect()} == {"1": ('{"a": 1}', 1), "2": ('{"a": 2}', 2)}
    assert extract.batch_report(got).first()["repaired"] == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    found = readers.files(spark, str(tmp_path))
    assert {r["path"][-5:]: r["rejected"] for r in found.collect()} == {"a.pdf": None, "b.pdf": "magic"}
    assert [r["text"] for r in readers.parse_files(found, lambda b: ["", b.decode()]).collect()] == ["%PDF-1.4 x"]
    out = str(tmp_path / "out")
    sinks.write_new(found.select("path"), out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_new(found.select("path"), out)
    assert sinks.provenance(found).first()["n_files"] == 2
    (tmp_path / "r.yaml").write_text("rows:\n- {id: a, name: A}\n")
    assert readers.registry(spark, str(tmp_path / "r.yaml"), "rows", "id string, name string").collect()[0]["name"] == "A"


def test_streaming_ingest(spark, tmp_path):
    from attestor.streaming import ingest

    schema = "source_id string, content_hash string, retrieved_at timestamp, arrival long"
    spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "source_id string, content_hash string, arrival long").selectExpr("source_id", "content_hash", "timestamp_seconds(arrival) retrieved_at", "arrival").write.parquet(str(tmp_path / "in"))
    query = ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "check"))
    query.awaitTermination()
    rows = ingest.versions(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert {r["content_hash"]: r["is_current"] for r in rows} == {"a": False, "b": True}


def test_research_stops(spark):
    pages = spark.createDataFrame([(str(i), f"http://h{i}.com/", "solar panel " * (i + 1)) for i in range(4)], "result_id string, url string, content string")
    rows = research.run(pages, ["solar"], rounds=3).collect()
    assert len(rows) == 4 and rows[0]["stopped"] in ("no_information_gain", "no_grounded_followup_queries")
