"""Queries of identities, guards, set operations and run records on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import text as t
from attestor.operators import indicators, research, rules
from attestor.session import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(r"""select c_custkey, 'co_' || substr(sha256(trim(regexp_replace(replace(lower(c_name), 'ß', 'ss'), '[ \t\n\r\f\x0b]+', ' ', 'g'))), 1, 32) company_id,
  'kch_' || substr(sha256('{"layer":"general","name":"' || c_name || '","version":"' || c_custkey || '"}'), 1, 32) chunk_id from customer""")
def identity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed ids: of a normalised name, and of a canonical JSON object."""
    chunk = t.json_id("kch_", version=F.col("c_custkey").cast("string"), name=F.col("c_name"), layer=F.lit("general"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.company_id(F.col("c_name")).alias("company_id"), chunk.alias("chunk_id"))


@query("""with f as (select l_orderkey k, l_orderkey || '-' || l_linenumber id, l_returnflag = 'N' weak from lineitem),
d as (select o_orderkey k, o_custkey c, case o_orderstatus when 'F' then 'supported' when 'O' then 'conflict' else 'no_evidence' end status, [o_orderkey || '-1', o_orderkey || '-2'] s, case when o_orderkey % 2 = 0 then [o_orderkey || '-3'] when o_orderkey % 5 = 0 then [o_orderkey || '-1'] else [] end c_ from orders),
g as (select d.*, list_filter(s, lambda x: list_contains(coalesce(ids, []), x) and not list_contains(c_, x)) gs, list_filter(c_, lambda x: list_contains(coalesce(ids, []), x) and not list_contains(s, x)) gc, len(list_intersect(s, c_)) > 0 over_,
  len(list_filter(list_distinct(list_concat(s, c_)), lambda x: not list_contains(coalesce(ids, []), x))) > 0 invalid,
  (select bool_and(weak) from f where f.k = d.k and (list_contains(d.s, f.id) or list_contains(d.c_, f.id))) weak from d left join (select k, list(id) ids from f group by k) l using (k)),
r as (select k, c, status, gs, gc, case when status = 'no_evidence' then 'no_evidence' when over_ then case when len(gs) + len(gc) = 0 then 'no_evidence' else 'limited_support' end
  when status = 'supported' and invalid then case when len(gs) = 0 then 'no_evidence' else 'limited_support' end
  when status = 'conflict' and invalid then case when len(gs) > 0 and len(gc) > 0 then 'conflict' when len(gs) + len(gc) > 0 then 'limited_support' else 'no_evidence' end
  when status = 'supported' and len(gs) = 0 then 'limited_support' when status = 'conflict' and (len(gs) = 0 or len(gc) = 0) then 'limited_support' when status = 'supported' and weak then 'limited_support' else status end final from g)
select final status, count(*)::bigint n, count_if(final <> status)::bigint n_downgraded, sum(case when final = 'no_evidence' then 0 else len(gs) end)::bigint n_supporting, sum(case when final = 'no_evidence' then 0 else len(gc) end)::bigint n_contradicting from r group by final""")
def milestone_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as milestone drafts that cite lines as facts: references checked, statuses lowered to what they bear."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey").cast("string")
    ref = lambda n: F.concat(k, F.lit(f"-{n}"))
    status = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "conflict").otherwise("no_evidence")
    against = F.when(F.col("o_orderkey") % 2 == 0, F.array(ref(3))).when(F.col("o_orderkey") % 5 == 0, F.array(ref(1))).otherwise(F.array().cast("array<string>"))
    drafts = o.select(k.alias("company_id"), k.alias("milestone_id"), status.alias("status"), F.array(ref(1), ref(2)).alias("supporting"), against.alias("contradicting"))
    facts = line.select(F.col("l_orderkey").cast("string").alias("company_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.when(F.col("l_returnflag") == "N", "weak_web").otherwise("first_party").alias("quality"))
    out = rules.guard_milestones(drafts, facts)
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count_if("downgraded").alias("n_downgraded"), F.sum(F.size("supporting")).cast("long").alias("n_supporting"), F.sum(F.size("contradicting")).cast("long").alias("n_contradicting"))


@query(r"""with c as (select page_id, html, lower(regexp_extract(url, '(?i)^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), ':(80|443)$', '') canonical from pages)
select canonical, min(page_id) first_page, max(length(html))::int longest, count(*)::bigint n from c group by canonical""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results deduplicated by site: the first result, with the longest content that any of them has."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("result_id"), F.lit(0).alias("query_no"), F.regexp_extract("url", r"(?i)^(https?://[^/?#]+)", 1).alias("url"), F.col("html").alias("content"))
    n = pages.groupBy(t.canonical_url(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"))
    return research.dedupe(pages).join(n, "canonical").select("canonical", F.col("first.result_id").alias("first_page"), F.length("content").alias("longest"), "n")


@query("""with h as (select conv_id, turn, text from conversations where contains(lower(text), ' the ') or contains(lower(text), ' der ') or contains(lower(text), ' les '))
select conv_id, min(turn) first_turn, arg_min(sha256(text), turn) text_sha256, count(*)::bigint n_matches from h group by conv_id""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation that holds any of the keywords."""
    low = F.lower("text")
    hit = table(spark, sf_dir, "conversations").where(F.contains(low, F.lit(" the ")) | F.contains(low, F.lit(" der ")) | F.contains(low, F.lit(" les ")))
    return hit.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by(F.sha2("text", 256), "turn").alias("text_sha256"), F.count("*").alias("n_matches"))


@query("""with a as (select distinct l_partkey p from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey p from lineitem where l_linestatus = 'O')
select 'both' "set", count(*)::bigint n from a where p in (select p from b) union all select 'returned_only', count(*)::bigint from a where p not in (select p from b) union all select 'open_only', count(*)::bigint from b where p not in (select p from a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and differences of two sets of keys, in one pass over the lines."""
    line = table(spark, sf_dir, "lineitem")
    flags = line.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b"))
    n = flags.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("returned_only"), F.count_if(F.expr("b and not a")).alias("open_only"))
    return n.unpivot([], ["both", "returned_only", "open_only"], "set", "n")


@query("""with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) before, value from events)
select user_id, min(case when event_type = 'error' and before = 'error' or event_type = 'click' and before = 'click' then event_id end) stops_at, round(sum(value), 4) used, count(*)::bigint calls from e group by user_id""")
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a user: total use, and the call at which two failures stand in a row."""
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    twice = (F.col("event_type").isin("error", "click")) & (F.col("event_type") == F.col("before"))
    return e.groupBy("user_id").agg(F.min(F.when(twice, F.col("event_id"))).alias("stops_at"), F.round(F.sum("value"), 4).alias("used"), F.count("*").alias("calls"))


@query("""select l_orderkey, l_linenumber, case when o_orderkey is null then 'version' when c_custkey is null then 'source' end missing from lineitem
  left join (select * from orders where o_orderstatus <> 'P') o on l_orderkey = o_orderkey left join (select * from customer where c_acctbal >= 0) c on o_custkey = c_custkey where o_orderkey is null or c_custkey is null""")
def missing_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose version or source isn't there, by two joins instead of a lookup a chunk."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.withColumn("missing", F.when(F.col("o_orderkey").isNull(), "version").when(F.col("c_custkey").isNull(), "source")).where("missing is not null").select("l_orderkey", "l_linenumber", "missing")


@query("""select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_size || ' kg x-' || p_partkey), '[a-z]+[-_]?\\d[a-z0-9_-]*', ' ', 'g'), '(\\d+(?:\\.\\d+)?)', 1))), ',') numbers,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_size || ' kg x-' || p_partkey), '([a-z]+[-_]?\\d[a-z0-9_-]*)', 1))), ',') models from part""".replace("\\\\", "\\"))
def claim_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and model names of a claim, which guard its merging."""
    claim = F.concat_ws(" ", "p_name", "p_brand", "p_size", F.lit("kg"), F.concat(F.lit("x-"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(t.numbers(claim), ",").alias("numbers"), F.array_join(t.model_names(claim), ",").alias("models"))


@query("""with g as (select s_nationkey dimension, 'balance below ' || (round(s_acctbal / 1000) * 1000)::bigint description, s_suppkey rule from supplier),
f as (select dimension, description, min(rule) first_ from g group by dimension, description)
select dimension, string_agg(description, '; ' order by first_) descriptions, (select count(*) from g x where x.dimension = f.dimension)::bigint n_rules from f group by dimension""")
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a dimension: distinct descriptions in the order they first come, and how many rules gave them."""
    g = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dimension"), F.concat(F.lit("balance below "), (F.round(F.col("s_acctbal") / 1000) * 1000).cast("long").cast("string")).alias("description"), F.col("s_suppkey").alias("rule"))
    first = g.groupBy("dimension", "description").agg(F.min("rule").alias("first"), F.count("*").alias("n"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "description"))), lambda x: x["description"]), "; ")
    return first.groupBy("dimension").agg(texts.alias("descriptions"), F.sum("n").alias("n_rules"))


@query("""with o as (select c_custkey e, c_mktsegment s, case when contains(lower(c_mktsegment), 'auto') then 80 when contains(lower(c_mktsegment), 'mach') then 60 when contains(lower(c_mktsegment), 'build') then 35 end score from customer)
select s segment, case when score >= 60 then 'strength' when score <= 40 then 'risk' end kind, count(*)::bigint n from o where score >= 60 or score <= 40 group by s, kind""")
def strengths_and_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are strengths or risks."""
    low = F.lower("c_mktsegment")
    score = rules.cascade([(F.contains(low, F.lit(w)), s) for w, s in (("auto", 80), ("mach", 60), ("build", 35))])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("indicator"), score.cast("double").alias("score"))
    return indicators.notes(rows).groupBy(F.col("indicator").alias("segment"), "kind").agg(F.count("*").alias("n"))


@query()
def indicator_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technology and industry indicators of every document, with an appended sentence as the tables' words are made up."""
    said = F.when(F.col("doc_id") % 3 == 0, " It is in mass production.").when(F.col("doc_id") % 3 == 1, " A prototype of a novel method exists.").otherwise(" Few competitors, rapid growth.")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n."), said).alias("text"))
    return indicators.observe(docs, lambda c: indicators.technology(c) | indicators.industry(c))


@query()
def website_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that pages name as the official website of their site."""
    host = t.url_host(F.col("url"))
    name = F.regexp_extract("host", r"^(?:m\.|blog\.)?([^.]+)", 1)
    pages = table(spark, sf_dir, "pages").select(host.alias("host")).withColumn("name", name)
    said = pages.select(F.col("name").alias("company_id"), "name", "host", F.concat(F.lit("The official website of "), F.col("name"), F.lit(" is https://"), F.col("host"), F.lit("/ .")).alias("text")).distinct()
    return rules.website(rules.attested_hosts(said)).select("company_id", "status", "website", F.array_join("candidates", ",").alias("candidates"))
