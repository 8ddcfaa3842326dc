"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a folder of this machine is taken in
    local mode (tests), where driver and executors are one process; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="attestor-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestor-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written() tables that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getName().startswith("attestor-"):
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, again, in batches of at most about `most` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0)).astype(np.int64)
        block = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


#: Caches that a worker keeps from task to task, by the operator that fills them.
kept: dict[str, dict] = {}


def forget_others(own: str = "") -> None:
    """Drop what other operators have cached: a worker serves one after the other, as in the pipeline."""
    for name, cache in kept.items():
        if name != own:
            cache.clear()


def map_rows(df: DataFrame, columns: dict[str, str | Column], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow over the named columns only; make() runs once a task and gives the function for each slice. keeps: the
    name in `kept` of the caches that the tasks use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        each = make()
        for part in slices(batches):
            out = each(part)
            if out is not None and out.num_rows:
                yield out

    picked = df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
    return picked.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch[name].to_pylist()]


def words(text: Column) -> Column:
    """Words of a text, ASCII capitals lowered; null and blank texts have none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, SPACES), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the optimizer copies a projected column into each place that uses it,
    inside lambdas even once an element, but not what a lambda is bound to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- 64-bit hashing in numpy -------------------------------------------------

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = x ^ (x >> _S33)
    x = x * _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_held: dict[str, np.ndarray] = {}


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, I): the hash of data[a:b] is (P[b] - P[a]) * I[a], modulo 2**64."""
    n = len(data)
    if len(_held.get("p", ())) < n + 1:
        _held["p"], _held["i"] = _powers(BASE, n + 1), _powers(BASE_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _held["p"][:n], out=sums[1:])
    return sums, _held["i"]


def word_hashes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all rows, bounds): row i has words bounds[i]:bounds[i+1]. ASCII capitals are lowered.
    Each distinct word of the batch is hashed once, by xxh3."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch[name].cast(pa.string()), "")))
    own, offsets = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.binary_length(own)) > 0  # white space at the ends leaves empty words
    distinct = own.filter(pa.array(filled)).dictionary_encode()
    if isinstance(distinct, pa.ChunkedArray):
        distinct = distinct.combine_chunks()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.dictionary.to_pylist()), np.uint64, len(distinct.dictionary))
    return hashes[np.asarray(distinct.indices)], np.concatenate([[0], np.cumsum(filled)])[offsets]


_SHINGLE = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(16)]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the word shingles of each row; a row with fewer words than size has its whole sequence as one."""
    count = np.diff(bounds)
    n = len(hashes)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if len(full) else 0):
        full += hashes[k : n - size + 1 + k] * _SHINGLE[k]
    full = mix64(full)
    sizes = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    new = np.concatenate([[0], ends]).astype(np.int64)
    long = count >= size
    row = np.repeat(np.arange(len(count)), sizes)
    at = np.arange(len(out)) - new[row] + bounds[row]
    whole = long[row]
    out[whole] = full[at[whole]]
    for i in np.flatnonzero((count > 0) & ~long):
        own = hashes[bounds[i] : bounds[i + 1]]
        weights = np.asarray(_SHINGLE[size : size + len(own)], np.uint64)
        out[new[i]] = mix64(np.asarray([(own * weights).sum(dtype=np.uint64)]) + np.uint64(len(own)))[0]
    return out, new
