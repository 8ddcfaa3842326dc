"""MinHash near-dedup with circulant signatures (C-MinHash, Li and Li 2021), banding and exact Jaccard verification.

A text's set: its distinct five-word shingles, held as 64-bit hashes. Two permutations of the 32-bit integers give all
signature coordinates: sigma scatters the elements once; coordinate k is the minimum of pi(sigma(x) + k), the same pi
circularly shifted by k. BANDS bands of ROWS coordinates make documents meet. Two documents of similarity 0.85 share no
band with a probability under 1e-6. keep_one() and the pipeline link from 0.80 on and take WIDE_BANDS bands for it, which
leave the same probability at 0.80; LINK is the query's own bound.

Words are hashed by xxh3, shingles by a mix of five such hashes. Documents of equal sets form a class at once (grouped by
a 128-bit digest of the set; a class is named by both halves of it everywhere) and only classes go on. Classes
that share no band with another are done. Of the others the sets are read once, and two exact bounds need no pair: a
class whose unshared shingles (found in no other candidate's set) exceed 100 - link % can't be linked at all, and two
classes can't if the shared part of one is too small against their sizes and unshared shingles together.

In a band's bucket no pairs are enumerated: first every member is compared with the bucket's most shared one, its
leader. Then, in rounds, members that are still in another component than the leader are compared with a sample of the
bucket that grows until it is the whole bucket, only across components and within the bounds. So every candidate pair
that could join two components is verified, and a group of n copies costs about n comparisons a band instead of n
squared. Links are verified on full sets; components never reach the driver.

Defined cases: a null or blank text has an empty set, n_shingles 0, and is linked with nothing; a text of fewer than
five words has its whole sequence as one shingle; rows with a null doc_id are linked with nothing and keep a null
component_id with kept true; rows that share a doc_id are one document, linked by each of their texts, and give one row
each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import dropped, map_rows, mix64, shingle_hashes, table, word_hashes, written
from attestor.llm.components import components

SIZE, BANDS, ROWS = 5, 24, 5
LINK = 85  # 100 * intersection >= LINK * union
WIDE_LINK, WIDE_BANDS = 80, 35  # of keep_one()
GROWTH = 16  # factor of a bucket's sample from round to round
_SEED = np.uint32(0x85EBCA6B)
ID = pa.decimal128(38, 0)


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """[rows, coordinates] of the non-empty rows: circulant MinHash of each."""
    sigma = _pi((shingles >> np.uint64(32)).astype(np.uint32) ^ _SEED)  # 32 bits of a mixed hash, permuted once
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    out = np.empty((len(starts), coordinates), np.uint32)
    step = np.uint32(0x9E3779B1)  # shifts by k * step: a circular shift by distinct amounts, spread over the circle
    for k in range(coordinates if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(_pi(sigma + np.uint32(k * int(step) & 0xFFFFFFFF)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[documents, bands]: one 64-bit key a band, different from band to band."""
    grouped = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def set_id(own: np.ndarray) -> Decimal:
    """Digest of a set of distinct hashes, 125 bits of two independent halves: a number that Spark sorts, hashes and
    aggregates by."""
    first = int(own.sum(dtype=np.uint64))
    second = int(np.bitwise_xor.reduce(mix64(own + np.uint64(0x632BE59BD9B4E019))))
    return Decimal((first << 61) | (second >> 3))


def sketch(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, the digest of the set (id) and the band keys of each document."""

    def make():
        def each(batch):
            shingles, bounds = shingle_hashes(*word_hashes(batch), size)
            n = batch.num_rows
            count, ids = np.zeros(n, np.int64), [None] * n
            for i in np.flatnonzero(bounds[:-1] < bounds[1:]):
                own = np.unique(shingles[bounds[i] : bounds[i + 1]])
                count[i] = len(own)
                ids[i] = set_id(own)
            keys = band_keys(signatures(shingles, bounds, bands * rows), bands, rows)
            filled = count > 0
            offsets = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(count), pa.array(ids, ID), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                ["doc_id", "n_shingles", "id", "bands"],
            )

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, "doc_id long, n_shingles long, id decimal(38,0), bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id and the distinct shingle hashes of each wanted class (id, rep), from its smallest document."""

    def make():
        def each(batch):
            shingles, bounds = shingle_hashes(*word_hashes(batch), size)
            ids, found = [], []
            for i, asked in enumerate(batch["id"].to_pylist()):
                own = np.unique(shingles[bounds[i] : bounds[i + 1]])
                if len(own) and set_id(own) == asked:  # a doc_id may have several texts
                    ids.append(asked)
                    found.append(own.view(np.int64))
            if not ids:
                return None
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids, ID), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["id", "set"])

        return each

    both = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"]).where("rep is not null and text is not null").join(wanted.select("id", "rep").hint("merge"), "rep")
    return map_rows(both, {"id": "id", "text": "text"}, make, "id decimal(38,0), set array<long>").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(f"100 * common >= {link} * (n + m - common)").select("a", "b")


def classes(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    spark = docs.sparkSession
    own = written(sketch(docs, size, bands, rows), "sketch")
    full = own.where("doc_id is not null and n_shingles > 0")
    groups = full.groupBy("id", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    keys = written(groups.select("id", "rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")), "keys")
    crowded = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    near = written(keys.join(crowded, "key", "left_semi"), "near")
    sets = written(_sets(docs, near.select("id", "rep").distinct(), size), "sets")

    # shingles that no other candidate has; 32 bits of a hash will do, as a collision only makes a bound weaker
    single = sets.select("id", F.explode(F.transform("set", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))).alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    single = single.groupBy("id").agg(F.count("*").alias("u"))
    near = near.join(single, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(f"100 * (n - u) >= {link} * n")
    near = written(near, "shared")
    buckets = near.groupBy("key").agg(F.min(F.struct("u", "rep", "id", "n")).alias("leader"), F.count("*").alias("members")).where("members > 1")
    buckets = buckets.select("key", "members", F.col("leader.id").alias("leader"), F.col("leader.n").alias("n0"), F.col("leader.u").alias("u0"))
    members = written(near.join(buckets, "key"), "members")

    # else the sets can't be similar enough: by their sizes, and by what each has alone
    alike = f"100 * least(n, n0) >= {link} * greatest(n, n0) and 100 * least(n - u, n0 - u0) >= {link} * (u + u0 + greatest(n - u, n0 - u0))"
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tested = written(members.where(f"id <> leader and {alike}").select(F.col("leader").alias("a"), F.col("id").alias("b")).select(*pair).distinct(), "pairs")
    # a document with several texts links their classes
    same = full.groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("all")).where("size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b")
    linked = written(_verified(tested, sets, link).unionByName(same), "linked")
    found = written(components(linked), "components")
    before, share = 0, GROWTH
    most = members.agg(F.max("members")).first()[0] or 0
    while most > 2:  # in buckets of two the star is all there is
        at = members.where("members > 2").join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
        # members outside the leader's component, and a growing sample of all members
        mixed = at.groupBy("key").agg(F.max(F.when(F.col("id") == F.col("leader"), F.col("c"))).alias("c0"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key", "c0")
        open_keys = written(at.join(mixed, "key"), "mixed")
        if open_keys.isEmpty():  # every bucket lies in one component, and components only grow
            break
        chance = (F.pmod(F.xxhash64("key", "id"), F.lit(1 << 20)) / F.lit(1 << 20)) * F.col("members")
        at = open_keys.join(open_keys.groupBy("id").agg(F.collect_set("key").alias("keys")), "id").withColumn("chance", chance)
        other = at.where("c <> c0").select("key", F.col("id").alias("b"), F.col("c").alias("cb"), "n", "u", F.col("keys").alias("kb"), F.col("chance").alias("xb"))
        probe = at.where((F.col("chance") >= before) & (F.col("chance") < share)).select("key", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("n0"), F.col("u").alias("u0"), F.col("keys").alias("ka"), F.expr("c <> c0").alias("outside"))
        # a pair that meets in several buckets is taken in the first of them only
        once = F.array_min(F.array_intersect("ka", "kb")) == other["key"]
        # of two outside the leader's component, the one that is sampled first is the probe
        once &= ~F.expr(f"outside and (xb < {before} or xb < {share} and a > b)")
        pairs = other.join(probe, (other["key"] == probe["key"]) & F.expr(f"ca <> cb and {alike}") & once).select(*pair).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        dropped(spark, open_keys)
        fresh = written(_verified(pairs, sets, link), "linked")
        if not fresh.isEmpty():
            linked = linked.unionByName(fresh)
            found = written(components(linked), "components")
        elif share >= most:
            break
        tested = tested.unionByName(pairs)
        before, share = share, share * GROWTH
    node = full.select("doc_id", "n_shingles", "id").join(found, F.col("id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("c"))
    least = node.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = node.join(least, "c").select("doc_id", "n_shingles", "component_id")
    rest = own.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    dropped(spark, keys, sets, members)
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; linked from WIDE_LINK on."""
    options = {"bands": WIDE_BANDS, "link": WIDE_LINK} | options
    gone = classes(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') own
  from documents),
s as (
  select distinct doc_id, unnest(case when len(own) >= 5 then list_transform(range(1, len(own) - 3), lambda i: array_to_string(own[i:i + 4], ' ')) when len(own) > 0 then [array_to_string(own, ' ')] else [] end) s
  from w),
n as (select doc_id, count(*) n from s group by doc_id),
links as (
  select x.doc_id a, y.doc_id b from s x join s y using (s) join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  where x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach as (select doc_id node, doc_id other from n union select r.node, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.component, d.doc_id) component_id, d.doc_id = coalesce(c.component, d.doc_id) kept
from documents d left join n using (doc_id) left join (select node, min(other) component from reach group by node) c on c.node = d.doc_id
"""
