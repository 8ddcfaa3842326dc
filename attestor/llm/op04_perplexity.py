"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on the trusted documents.

The model's units are code points, each its own, so that languages with rich or unseen words are scored alike; ORDER
units of 21 bits make a key of two 64-bit halves (`lo` the last three units, `hi` those before). Trusted are the
documents labelled good; one in HELD of them, by a hash of doc_id, is held out of the training. Counts are taken over all
text of the others, pre-aggregated in each slice, and summed in shards by key. Discounts, context sums, continuation
counts and the probabilities of every order are joins and aggregates over these sharded tables. N-grams that begin with
the start mark keep their counts in the lower orders, as nothing else can stand before them.

Scoring goes by files of the document table. The distinct keys of each file are joined with the sharded model, and the
answers are written to the shared folder, a part for each file. A task then reads its file's answers and sums up whole
texts. Neither the texts nor a row for each n-gram of a document are shuffled, nothing grows on the driver, and no model
is broadcast.

A document is kept if its perplexity is at most its language's threshold: the QUANTILE of the held-out documents of that
language (of all, where it has none), which the model has not seen; a few documents hardly show that quantile, so it is
not taken lower than the quantile of the normal distribution of their logarithms' mean and deviation. For this comparison each text is taken to be longer
by PRIOR units of its language's mean, as the perplexity of a few words says little.

Defined cases: a null or empty text has no units, a null perplexity and isn't kept; rows with a null doc_id are scored
but never trusted; a null language is a language of its own; repeated rows count as often as they stand there; a label
conflict counts as not trusted; without trusted text every perplexity is null and everything with a text is kept, and
without held-out documents the trusted ones set the thresholds; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import fresh_path, slices, table, texts, written

ORDER, QUANTILE, PRIOR, HELD = 5, 0.995, 60, 4
BITS = 21
_MASK = (1 << BITS) - 1
_START, _END = 0x110000, 0x110001  # beyond the code points, so no text holds them


def units_of(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start marks, units and end mark of each text, one after the other; the place after the last of each)."""
    marks, end = np.full(ORDER - 1, _START, "<u4").tobytes(), np.asarray([_END], "<u4").tobytes()
    units = np.frombuffer(b"".join([marks + t.encode("utf-32-le") + end for t in texts_]), "<u4").astype(np.int64)
    return units, np.cumsum([len(t) + ORDER for t in texts_], dtype=np.int64)


def grams_of(texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ORDER-grams of some texts (hi, lo), for each text and place which it is, and the places a text has."""
    units, ends = units_of(texts_)
    lengths = np.diff(ends, prepend=0) - (ORDER - 1)
    if not len(units):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), lengths
    last = np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(int(lengths.sum()))  # of each gram
    place = np.zeros(_END + 1, np.int64)
    place[units] = 1
    alphabet = np.flatnonzero(place)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * ORDER < 64:  # a gram is one integer of places in the alphabet
        place[alphabet] = np.arange(len(alphabet))
        dense = place[units]
        packed = np.zeros(len(last), np.int64)
        for k in range(ORDER):
            packed = packed << bits | dense[last - (ORDER - 1) + k]
        found = pa.array(packed).dictionary_encode()
        values, mask = np.asarray(found.dictionary), (1 << bits) - 1
        own = alphabet[(values[:, None] >> np.arange((ORDER - 1) * bits, -1, -bits)) & mask]
    else:
        whole = units[last[:, None] + np.arange(1 - ORDER, 1)].astype("<u4")
        kind = pa.binary(4 * ORDER)
        found = pa.Array.from_buffers(kind, len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole))]).dictionary_encode()
        own = np.frombuffer(b"".join(found.dictionary.to_pylist()), "<u4").astype(np.int64).reshape(-1, ORDER)
    hi, lo = _halves(own.ravel(), np.arange(len(own)) * ORDER + ORDER - 1)
    return hi, lo, np.asarray(found.indices).astype(np.int64), lengths


def _halves(units: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = np.zeros(len(last), np.int64), np.zeros(len(last), np.int64)
    for k in range(ORDER - 1, 2, -1):
        hi = hi << BITS | units[last - k]
    for k in range(2, -1, -1):
        lo = lo << BITS | units[last - k]
    return hi, lo


def _as_bytes(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Both halves as sixteen bytes that sort as the pair does."""
    return np.stack([hi, lo], 1).astype(">i8").view("S16").ravel()


def _suffix(k: int) -> tuple[Column, Column]:
    """(hi, lo) of the last k units."""
    if k <= 3:
        return F.lit(0).cast("long"), F.col("lo").bitwiseAND(F.lit((1 << BITS * k) - 1))
    return F.col("hi").bitwiseAND(F.lit((1 << BITS * (k - 3)) - 1)), F.col("lo")


def _context(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) without the last unit."""
    return F.shiftrightunsigned(hi, BITS), F.shiftrightunsigned(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND(F.lit(_MASK)), 2 * BITS))


def _starts(k: int) -> Column:
    """Whether a k-gram begins with the start mark."""
    first = F.shiftrightunsigned("lo", BITS * (k - 1)) if k <= 3 else F.shiftrightunsigned("hi", BITS * (k - 4))
    return first.bitwiseAND(F.lit(_MASK)) == _START


def by_file(docs: DataFrame) -> DataFrame:
    """docs with the file that each row comes from; a table that comes from none is written first."""
    try:
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"], F.xxhash64("_metadata.file_path").alias("file"))
    except AnalysisException:
        docs = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"]), "documents")
        return docs.select("doc_id", "text", "lang", F.xxhash64("_metadata.file_path").alias("file"))


class SideTable:
    """A table written in parts by file; a task reads the part of the file that it works on."""

    def __init__(self, rows: DataFrame, name: str):
        self.path = fresh_path(rows.sparkSession, name)
        self.columns = [c for c in rows.columns if c != "file"]
        # one file a part: rows of a file are sorted by the first column
        rows.repartition(F.col("file")).sortWithinPartitions("file", self.columns[0]).write.partitionBy("file").parquet(self.path)

    def read(self, file: int) -> list[np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        at = f"{base}/file={file}"
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        tables = [pq.read_table(f.path, filesystem=system, partitioning=None) for f in found if f.path.endswith(".parquet")]
        whole = pa.concat_tables(tables) if tables else None
        return [np.asarray(whole[c].combine_chunks()) if whole is not None else np.zeros(0, np.int64) for c in self.columns]


def _runs(batch: pa.RecordBatch):
    """The parts of a batch that come from one file."""
    file = np.asarray(batch["file"])
    cuts = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(file[a]), batch.slice(a, b - a)


def _counted(docs: DataFrame, trusted: SideTable) -> DataFrame:
    """hi, lo and c over the trusted documents that aren't held out."""

    def run(batches):
        at, own = None, set()
        for batch in slices(batches):
            for file, part in _runs(batch):
                if file != at:
                    ids, held = trusted.read(file)
                    at, own = file, set(ids[held == 0].tolist())
                hi, lo, which, _ = grams_of([t for d, t in zip(part["doc_id"].to_pylist(), texts(part), strict=True) if d in own and t])
                if len(hi):
                    yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.bincount(which, minlength=len(hi)).astype(np.int64))], ["hi", "lo", "c"])

    return docs.select("doc_id", "text", "file").mapInArrow(run, "hi long, lo long, c long").groupBy("hi", "lo").agg(F.sum("c").alias("c"))


def _asked(docs: DataFrame) -> DataFrame:
    """file, hi and lo, each once."""

    def run(batches):
        for batch in slices(batches):
            for file, part in _runs(batch):
                hi, lo, _, _ = grams_of([t for t in texts(part) if t])
                if len(hi):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), file)), pa.array(hi), pa.array(lo)], ["file", "hi", "lo"])

    return docs.select("text", "file").mapInArrow(run, "file long, hi long, lo long").distinct()


def model(counts: DataFrame) -> list[dict[str, DataFrame]]:
    """For each order 1 .. ORDER: `seen` (hi, lo, p) of its n-grams and `back` (hi, lo, g): of each context, the weight of
    the lower order."""
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many n-grams of the next order it ends
        hi, lo = _suffix(k)
        short = orders[0].select(hi.alias("hi"), lo.alias("lo"), "c").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
        orders.insert(0, written(short.select("hi", "lo", F.when(_starts(k), F.col("c")).otherwise(F.col("n")).alias("c")), f"order{k}"))
    out, lower = [], None
    for k, grams in enumerate(orders, 1):
        n = grams.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (max(1, n[f"n{i}"]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        hi, lo = _context(F.col("hi"), F.col("lo"))
        grams = grams.withColumns({"cut": cut, "chi": hi, "clo": lo})
        back = grams.groupBy("chi", "clo").agg(F.sum("c").alias("total"), F.sum("cut").alias("held")).select("chi", "clo", "total", (F.col("held") / F.col("total")).alias("g"))
        both = grams.join(back, ["chi", "clo"]).select("hi", "lo", "g", ((F.col("c") - F.col("cut")) / F.col("total")).alias("own"))
        if lower is None:
            units = orders[0].count() + 1  # one more for units never seen
            seen = both.select("hi", "lo", (F.col("own") + F.col("g") / units).alias("p"))
            floor = {"p": 1.0 / units}
        else:
            hi, lo = _suffix(k - 1)
            lower = lower.select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("p0"))
            seen = both.withColumns({"shi": hi, "slo": lo}).join(lower, ["shi", "slo"]).select("hi", "lo", (F.col("own") + F.col("g") * F.col("p0")).alias("p"))
        lower = written(seen, f"seen{k}")
        out.append({"seen": lower, "back": back.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"), "g")} | (floor if k == 1 else {}))
    return out


def answers(asked: DataFrame, orders: list[dict[str, DataFrame]]) -> DataFrame:
    """hi, lo and log p of every distinct key that is asked for."""
    now = asked.select("hi", "lo").distinct()
    weight, p = F.lit(1.0), F.lit(None).cast("double")
    for k in range(ORDER, 0, -1):
        hi, lo = _suffix(k)
        now = now.withColumns({"phi": hi, "plo": lo}).join(orders[k - 1]["seen"].select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("p").alias(f"p{k}")), ["phi", "plo"], "left")
        # the first order that has seen the n-gram decides; on the way the contexts' weights are multiplied
        p = F.coalesce(p, weight * F.col(f"p{k}"))
        if k > 1:
            hi, lo = _context(F.col("phi"), F.col("plo"))
            now = now.withColumns({"phi": hi, "plo": lo}).join(orders[k - 1]["back"].select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("g").alias(f"g{k}")), ["phi", "plo"], "left")
            weight = weight * F.coalesce(F.col(f"g{k}"), F.lit(1.0))
        now = now.drop("phi", "plo")
    back = orders[0]["back"].first()
    unseen = weight * F.lit((back["g"] if back else 1.0) * orders[0]["p"])
    return now.select("hi", "lo", F.log(F.coalesce(p, unseen)).alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_units, perplexity, trusted and held (out of the training) of every row of docs."""
    docs = by_file(docs)
    good = labels.where("doc_id is not null and quality is not null").groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = (F.pmod(F.xxhash64("doc_id", F.lit(HELD)), F.lit(HELD)) == 0).cast("int").alias("held")
    trusted = SideTable(docs.select("file", "doc_id").join(good, "doc_id", "left_semi").distinct().select("file", "doc_id", held), "trusted")
    counts = written(_counted(docs, trusted), "counts")
    empty = counts.isEmpty()
    if not empty:
        asked = written(_asked(docs), "asked")
        table_ = SideTable(asked.join(answers(asked, model(counts)), ["hi", "lo"]).select("file", "hi", "lo", "logp"), "answers")

    def run(batches):
        at = None
        for batch in slices(batches):
            for file, part in _runs(batch):
                if file != at:
                    ids, out = trusted.read(file)
                    at, own, apart = file, set(ids.tolist()), set(ids[out == 1].tolist())
                    if not empty:
                        hi, lo, logp = table_.read(file)
                        key = _as_bytes(hi, lo)
                        order = np.argsort(key)
                        key, logp = key[order], logp[order]
                found = texts(part)
                size = [len(t) for t in found]
                value: list[float | None] = [None] * len(found)
                if not empty:
                    hi, lo, which, lengths = grams_of([t for t in found if t])
                    sums = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(key, _as_bytes(hi, lo))][which])]) if len(hi) else np.zeros(1)
                    ends = np.cumsum(lengths)
                    scores = iter([float(np.exp(-(sums[e] - sums[e - n]) / n)) for e, n in zip(ends, lengths, strict=True)])
                    value = [next(scores) if t else None for t in found]
                ids = part["doc_id"].to_pylist()
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"].cast(pa.string()), pa.array(size, pa.int64()), pa.array(value, pa.float64()), pa.array([d in own for d in ids], pa.bool_()), pa.array([d in apart for d in ids], pa.bool_())], ["doc_id", "lang", "n_units", "perplexity", "trusted", "held"])

    return docs.select("doc_id", "text", "lang", "file").mapInArrow(run, "doc_id long, lang string, n_units long, perplexity double, trusted boolean, held boolean")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_units, perplexity (six decimals), threshold and kept of every row of docs."""
    scored = written(perplexities(docs, labels), "perplexity")
    apart = "held and perplexity is not null"
    if scored.where(apart).isEmpty():
        apart = "trusted and perplexity is not null"
    known = scored.where(apart)
    overall = known.agg(F.avg(F.log("perplexity")).alias("h")).first()["h"]
    mean = known.groupBy("lang").agg(F.avg(F.log("perplexity")).alias("h")).select(F.col("lang").alias("_lang"), "h")
    scored = scored.join(mean, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("h", F.coalesce("h", F.lit(overall).cast("double"))).drop("_lang")
    scored = scored.withColumn("level", F.exp((F.log("perplexity") * F.col("n_units") + F.col("h") * PRIOR) / (F.col("n_units") + PRIOR)))
    known = scored.where(apart)
    normal = F.exp(F.avg(F.log("level")) + NormalDist().inv_cdf(quantile) * F.stddev(F.log("level")))
    limit = F.greatest(F.percentile_approx("level", quantile, 100_000), normal)  # a null deviation, of one document, is passed over
    least = known.agg(limit.alias("t")).first()["t"]
    each = known.groupBy("lang").agg(limit.alias("t")).select(F.col("lang").alias("_lang"), "t")
    out = scored.join(each, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("t", F.lit(least).cast("double")))
    kept = F.when(F.col("n_units") == 0, False).when(F.col("threshold").isNull(), True).otherwise(F.col("level") <= F.col("threshold"))
    return out.select("doc_id", "lang", "n_units", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
