"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of WINDOW lines chooses the chunk ends of a text, so an inserted or deleted line moves
the ends next to it only. A chunk of two or more lines with words whose bytes have occurred before, anywhere in the
corpus, is removed; its first occurrence (smallest doc_id, then smallest place) stays. Chunks of one such line stay.

Digests find the repeats; the chunks themselves are then grouped by their bytes, so equality is decided by comparison.
Digest rows are aggregated before they are shuffled, and only chunks whose digest repeats go on to the comparison. The
joins are merge joins at every size: what repeats grows with the corpus, so none of it is broadcast.

Passages of a few lines seldom hold a whole chunk. With fine=True (the query and the pipeline) a second resolution takes
what the chunks leave: windows of two neighbouring lines with words, at every line. A line goes if it stands in a window
whose bytes have occurred before; that grows each repeated chunk to the edges of the passage and finds passages of two
lines or more that hold no chunk. Blank lines go with the window or chunk that they stand in. Windows are compared by
SHA-256, as their bytes are twice the text; a window that overlaps its own first occurrence stays.

Defined cases: null texts stay null and blank ones as they are; rows with a null doc_id neither lose chunks nor count
as an occurrence; rows that share a doc_id count as one document where the same chunk stands in the same place; further
columns are passed on by dedup() and ignored by counts(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import map_rows, slices, table, texts, written

WINDOW, DIVISOR, LEAST_LINES, MOST_LINES = 2, 3, 2, 64
SCHEMA = "doc_id long, n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long, kept_sha256 string"
_MASK = (1 << 64) - 1


def chunks_of(text: str) -> list[tuple[list[str], int]]:
    """(lines, lines with a word) of each chunk of a text. A chunk ends where the rolling hash over the last WINDOW
    line hashes is divisible by DIVISOR, after LEAST_LINES lines with words, or at MOST_LINES lines."""
    out, lines, filled, rolling, recent = [], [], 0, 0, [0] * WINDOW
    factor = 0x9E3779B97F4A7C15
    leave = pow(factor, WINDOW, 1 << 64)
    for line in text.split("\n"):
        lines.append(line)
        if line and not line.isspace():
            filled += 1
            h = xxhash.xxh3_64_intdigest(line)
            rolling = (rolling * factor + h - recent[0] * leave) & _MASK
            recent = [*recent[1:], h]
            mixed = (rolling ^ rolling >> 29) * 0xBF58476D1CE4E5B9 & _MASK
            if filled >= LEAST_LINES and (mixed >> 32) % DIVISOR == 0 or len(lines) >= MOST_LINES:
                out.append((lines, filled))
                lines, filled = [], 0
    if lines:
        out.append((lines, filled))
    return out


def _digests(body: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(body)
    return (x >> 64) - (1 << 63), (x & _MASK) - (1 << 63)


def _chunks(docs: DataFrame, bodies: bool) -> DataFrame:
    """doc_id, place and digest of each chunk of several lines, and its bytes where asked for."""
    names = ["doc_id", "at", "h1", "h2"] + ["body"] * bodies
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * bodies

    def make():
        def each(batch):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch), strict=True):
                for at, (lines, filled) in enumerate(chunks_of(text)):
                    if filled >= 2:
                        body = "\n".join(lines).encode()
                        rows.append((doc_id, at, *_digests(body)) + (body,) * bodies)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return each

    some = docs.where(docs["doc_id"].isNotNull() & docs["text"].contains("\n"))
    return map_rows(some, {"doc_id": "doc_id", "text": "text"}, make, "doc_id long, at int, h1 long, h2 long" + ", body binary" * bodies)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id and cut, the places and digests of the chunks that have occurred before, of each document with any."""
    digests = _chunks(docs, False)
    again = written(digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    bodies = written(_chunks(docs, True).join(again.hint("merge"), ["h1", "h2"], "left_semi"), "chunks")
    first = bodies.groupBy("h1", "h2", "body").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = bodies.join(first, ["h1", "h2", "body"]).where(F.struct("doc_id", "at") != F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("at", "h1")).alias("cut"))


def windows_of(lines: list[str]) -> list[tuple[int, int, bytes]]:
    """(first line, last line, digest of the bytes) of each two neighbouring lines with words."""
    filled = [i for i, line in enumerate(lines) if line and not line.isspace()]
    return [(a, b, hashlib.sha256("\n".join(lines[a : b + 1]).encode()).digest()) for a, b in zip(filled, filled[1:], strict=False)]


def window_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and cut as of repeats(), for windows: at is -1 less the window's number, h1 the first half of its digest."""

    def make():
        def each(batch):
            ids, at, key = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch), strict=True):
                own = windows_of(text.split("\n"))
                ids += [doc_id] * len(own)
                at += range(len(own))
                key += [k for _, _, k in own]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(key, pa.binary())], ["doc_id", "at", "key"])

        return each

    some = docs.where(docs["doc_id"].isNotNull() & docs["text"].contains("\n"))
    found = written(map_rows(some, {"doc_id": "doc_id", "text": "text"}, make, "doc_id long, at int, key binary"), "windows")
    first = found.groupBy("key").agg(F.min("doc_id").alias("d"), F.min_by("at", F.struct("doc_id", "at")).alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "d", "a")
    later = found.join(first.hint("merge"), "key").where("doc_id > d or at > a + 1")
    h1 = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct((-1 - F.col("at")).alias("at"), h1.alias("h1"))).alias("cut"))


def _split(text: str, cut) -> tuple[list[tuple[list[str], int]], list[bool], list[str]]:
    """The chunks, which of them go, and the lines that stay. A chunk goes if none of its lines with words stays."""
    parts = chunks_of(text)
    gone = {(c["at"], c["h1"]) for c in cut or ()}
    if not gone:
        return parts, [False] * len(parts), [line for lines, _ in parts for line in lines]
    flags = [filled >= 2 and (at, _digests("\n".join(lines).encode())[0]) in gone for at, (lines, filled) in enumerate(parts)]
    whole = [line for lines, _ in parts for line in lines]
    out = [g for (lines, _), g in zip(parts, flags, strict=True) for _ in lines]
    if any(at < 0 for at, _ in gone):
        for i, (a, b, key) in enumerate(windows_of(whole)):
            if (-1 - i, int.from_bytes(key[:8], "big") >> 4) in gone:
                out[a : b + 1] = [True] * (b + 1 - a)
        ends = list(itertools.accumulate(len(lines) for lines, _ in parts))
        flags = [g or filled >= 2 and all(o or not line or line.isspace() for line, o in zip(lines, out[e - len(lines) : e], strict=True)) for (lines, filled), e, g in zip(parts, ends, flags, strict=True)]
    return parts, flags, [line for line, o in zip(whole, out, strict=True) if not o]


def _joined(docs: DataFrame, fine: bool) -> DataFrame:
    """The columns of docs, then the places to cut, under a name that docs can't have."""
    name = f"_cut_{uuid.uuid4().hex}"
    cut = repeats(docs)
    if fine:
        cut = cut.unionByName(window_repeats(docs)).groupBy("doc_id").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    cut = written(cut.select(F.col("doc_id").alias("_id"), F.col("cut").alias(name)), "cuts")
    return docs.join(cut.hint("merge"), docs["doc_id"] == cut["_id"], "left").select(*[docs[c] for c in docs.columns], cut[name])


def counts(docs: DataFrame, fine: bool = False) -> DataFrame:
    """What is removed from each document, and the digest of the rest. fine: lines of repeated windows go as well."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text, cut in zip(batch["doc_id"].to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                parts, gone, rest = _split(text, cut)
                n = sum(len(lines) for lines, _ in parts)
                rows.append((doc_id, n, len(parts), sum(gone), n - len(rest), hashlib.sha256("\n".join(rest).encode()).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return _joined(own, fine).mapInArrow(run, SCHEMA)


def dedup(docs: DataFrame, fine: bool = False) -> DataFrame:
    """docs, all columns, with repeated chunks cut out of text and n_chars counted anew; a document that loses all its
    words goes. fine: lines of repeated windows go as well."""
    schema = docs.schema
    place = schema.fieldNames().index("text")
    counted = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches):
        for batch in slices(batches):
            new, keep, cuts = [], [], batch.column(len(schema)).to_pylist()
            for text, cut in zip(batch["text"].to_pylist(), cuts, strict=True):
                if cut:
                    text = "\n".join(_split(text or "", cut)[2])
                new.append(text)
                keep.append(not cut or bool(text.strip()))
            columns = [batch.column(i) for i in range(len(schema))]
            columns[place] = pa.array(new, columns[place].type)
            if counted is not None:
                kind = columns[counted].type
                columns[counted] = pa.array([old if not cut else len(t) for old, t, cut in zip(columns[counted].to_pylist(), new, cuts, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames()).filter(pa.array(keep))

    return _joined(docs, fine).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"), fine=True)
