"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

The set of a text is its distinct five-word shingles (words as in the other operators, ASCII capitals lowered). An item
is found in a document when the document's set holds at least THRESHOLD of the item's set. An item of fewer than five
words is one shingle of its own length, and found where the document has these words next to one another: documents
offer windows of one to four words too, but only of lengths that the items have.

Items are partitioned by the power of two of their set size. Each item keeps its MinHash sketch: the
q - ceil(t q) + 1 smallest hashes of its q shingles. A document that holds t q of them misses at most q - ceil(t q), so
it has one of the sketch: the search has no false negatives, however long the document is. A document offers its hashes
below the largest sketch value of any partition whose items are small enough for its size. Hits are pairs (document,
item), written and counted; each is verified by the exact intersection of the two sets of shingles, as words, not hashes.

Items and their sketches are broadcast only up to BROADCAST_ITEMS items of BROADCAST_SHINGLES shingles in all, and the
documents of hits only up to BROADCAST_HITS, so that no other document's text is shuffled; both are counted first, and
beyond them the same joins run shuffled.

Defined cases: null or blank texts have an empty set, which holds nothing and is found nowhere; rows with a null doc_id
or item_id take no part; of rows that share an id the one that holds
most counts (for items: their sets are united); further columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import let, table, words, written

SIZE, THRESHOLD = 5, 0.8
BROADCAST_ITEMS, BROADCAST_SHINGLES, BROADCAST_HITS = 20_000, 500_000, 1_000_000
_DOC, _ITEM = "_d", "_i"


def _windows(own: Column, sizes: list[int], one: Callable[[int, Column], Column], kind: str) -> Column:
    """Distinct one(size, first place) of the windows of each size; none where there are fewer words."""
    parts = []
    for size in sizes:
        found = F.transform(F.sequence(F.lit(1), F.size(own) - (size - 1)), partial(one, size))
        parts.append(F.when(F.size(own) >= size, found).otherwise(F.array().cast(kind)))
    return F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts))


def _hashes(own: Column, sizes: list[int]) -> Column:
    """64-bit hashes of the windows; the size goes in as well, so hashes of different sizes are apart."""

    def one(size: int, i: Column) -> Column:
        return F.xxhash64(*[F.get(own, i + (k - 1)) for k in range(size)], F.lit(size))

    return _windows(own, sizes, one, "array<bigint>")


def _shingles(own: Column, sizes: list[int]) -> Column:
    """The windows as text."""

    def one(size: int, i: Column) -> Column:
        return F.concat_ws(" ", F.slice(own, i, size))

    return _windows(own, sizes, one, "array<string>")


def _own_windows(own: Column, make) -> Column:
    """make() of an item: with fewer words than SIZE its whole sequence."""
    out = make(own, [SIZE])
    for n in range(1, SIZE):
        out = F.when(F.size(own) == n, make(own, [n])).otherwise(out)
    return out


def _need(q: Column) -> Column:
    return F.ceil(F.lit(int(THRESHOLD * 100)) * q / F.lit(100))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles of the item, n_common) of each document that holds an item."""
    spark = docs.sparkSession
    items = items.select(items["item_id"].alias(_ITEM), words(items["text"]).alias("own")).where(f"{_ITEM} is not null and size(own) > 0")
    lengths = sorted(r[0] for r in items.where(F.size("own") < SIZE).select(F.size("own")).distinct().collect())  # at most four
    items = items.select(_ITEM, let(F.col("own"), lambda own: _own_windows(own, _shingles)).alias("s"), let(F.col("own"), lambda own: _own_windows(own, _hashes)).alias("h"))
    sets = items.groupBy(_ITEM).agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("item_set"), F.array_distinct(F.flatten(F.collect_list("h"))).alias("hashes"))
    sets = sets.select(_ITEM, "item_set", F.size("item_set").alias("q"), F.array_sort("hashes").alias("hashes"))
    sets = sets.withColumn("part", F.floor(F.log2("q")).cast("int")).withColumn("need", _need(F.col("q")))
    sketch = sets.select(_ITEM, "part", "need", F.explode(F.slice("hashes", 1, F.size("hashes") - F.col("need").cast("int") + 1)).alias("h"))
    # one row for each of at most 31 partitions: the smallest need and the largest sketch value
    parts = sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("h").alias("top")).orderBy("part").collect()
    bound = sets.agg(F.count("*").alias("n"), F.sum("q").alias("s")).first()
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_common long")
    small = F.broadcast if bound["n"] <= BROADCAST_ITEMS and bound["s"] <= BROADCAST_SHINGLES else (lambda df: df)

    def offer(own: Column) -> Column:
        def below(found: Column) -> Column:
            top = F.lit(None).cast("long")
            for p in sorted(parts, key=lambda p: p["need"]):  # a larger document meets more partitions
                top = F.when(F.size(found) >= p["need"], F.lit(max(o["top"] for o in parts if o["need"] <= p["need"]))).otherwise(top)
            return let(top, lambda t: F.filter(found, lambda h: h <= t))

        return let(_hashes(own, [*lengths, SIZE]), below)

    # one expression, and explode_outer: no filter is derived that would compute the sets again
    offered = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].alias(_DOC), F.explode_outer(let(words(docs["text"]), offer)).alias("h"))
    hits = written(offered.join(small(sketch.select(_ITEM, "h")), "h").select(_DOC, _ITEM).distinct(), "hits")

    # Verification reads the texts of hit documents again; each pair holds its two sets.
    few = F.broadcast if hits.count() <= BROADCAST_HITS else (lambda df: df.hint("merge"))
    full = docs.select(docs["doc_id"].alias(_DOC), docs["text"].alias("text")).where(f"{_DOC} is not null and text is not null")
    full = full.join(few(hits.groupBy(_DOC).agg(F.collect_list(_ITEM).alias("asked"))), _DOC)
    # a document's set is made once, however many items it may hold
    held = full.select(_DOC, "asked", let(words(F.col("text")), lambda own: _shingles(own, [*lengths, SIZE])).alias("held"))
    pairs = held.select(_DOC, "held", F.explode("asked").alias(_ITEM)).join(small(sets.select(_ITEM, "item_set", "q", "need")), _ITEM)
    found = pairs.select(_DOC, _ITEM, "q", "need", F.size(F.array_intersect("item_set", "held")).alias("n_common")).groupBy(_DOC, _ITEM, "q", "need").agg(F.max("n_common").alias("n_common"))
    return found.where("n_common >= need").select(F.col(_DOC).alias("doc_id"), F.col(_ITEM).alias("item_id"), F.col("q").cast("long").alias("n_shingles"), F.col("n_common").cast("long").alias("n_common"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    found = written(search(docs, items).select(F.col("doc_id").alias("_found")).distinct(), "found")
    few = F.broadcast if found.count() <= BROADCAST_HITS else (lambda df: df.hint("merge"))
    return docs.join(few(found), docs["doc_id"] == found["_found"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') own
  from documents where doc_id is not null and text is not null),
wi as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') own
  from benchmark where item_id is not null and text is not null),
sizes as (select distinct least(len(own), 5) n from wi where len(own) > 0),
ds as (
  select distinct doc_id, n, unnest(list_transform(range(1, len(own) - n + 2), lambda i: array_to_string(own[i:i + n - 1], ' '))) s
  from w, sizes where len(own) >= n),
bs as (
  select distinct item_id, least(len(own), 5) n, unnest(list_transform(range(1, len(own) - least(len(own), 5) + 2), lambda i: array_to_string(own[i:i + least(len(own), 5) - 1], ' '))) s
  from wi where len(own) > 0),
q as (select item_id, count(*) n_shingles from bs group by item_id)
select ds.doc_id, bs.item_id, q.n_shingles::bigint n_shingles, count(*)::bigint n_common
from ds join bs using (n, s) join q using (item_id)
group by ds.doc_id, bs.item_id, q.n_shingles
having 100 * count(*) >= 80 * q.n_shingles
"""
