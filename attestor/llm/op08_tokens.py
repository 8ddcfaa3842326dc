"""Token ids in a binary file format: frequency-ranked ids, byte-aligned variable length, separate control bytes.

Texts are encoded with the tokenizers library. Its normalisation and splitting never join what white space parts, so a
text is cut at blanks and line ends, each distinct word is encoded once per worker, and the ids are put together. A word
of Latin letters between ASCII punctuation is what the library's normaliser and splitter take apart in one known way
(lower case, punctuation apart, nothing composed), so its parts go to the library's model at once; every other word goes
through the whole library.

Ids are ranked by their frequency over all documents (ties by id), and ranks are stored: two control bits give the
bytes of a value (one to four), four values share a control byte, control bytes and data bytes stand apart. Reading
expands the control bytes by a table lookup and gathers the data bytes with numpy.

Documents are dealt by ranges of (doc_id, hash of the ids) to tasks, at most MOST_TASKS of them, which Spark samples; a
task sorts its documents and writes them one block of BLOCK values after the other, beginning a new file whenever
file_text bytes of text are in the last, so files are alike at every size of the corpus and a task holds one block. Each
file has a name of its own in the shared folder and is reported in a row; only the rows that Spark commits make the
manifest, so a repeated task or a lost executor leaves at most an unlisted file.

A file: magic, then blocks. A block: three little-endian 64-bit counts (documents, values, data bytes), doc_ids, a null
flag for each, values a document, control bytes, data bytes. The manifest has part, number, file, n_docs, n_tokens;
ranks has rank and id.

Defined cases: a null text counts as empty and has the end id only; null doc_ids come first; rows that share a doc_id
are ordered by a hash of their ids, then the ids; further columns are ignored; an empty table gives an empty result and
no file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import fresh_path, kept, map_rows, table, texts, written

END_ID, FILE_BYTES, MAGIC = 2, 32 << 20, b"SVBRANK1"
CACHE, PARTS = 700_000, 200_000  # words, in two generations, and parts of words; about 200 bytes each
BLOCK = 1 << 20  # values of a block, a document more at most
MOST_TASKS = 100_000
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff"
# ASCII punctuation, Latin letters, ASCII punctuation; an apostrophe before letters may be a contraction, "<|" a special token
_PLAIN = re.compile(rf"([!-&(-/:-@\[-`{{-~]*)([{LATIN}]+)([!-/:-@\[-`{{-~]*)")
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Words to ids, as bytes of little-endian 32-bit integers; two generations of cached words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        mapping = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: mapping.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.parts: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probe = "Words, of (two) parts!! ÉÀÖ&&& déjà ...end"
        if b"".join(self.encode_batch([probe])) != np.asarray(self.library.encode(probe, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError("the vocabulary's normaliser or splitter isn't the one that the parts of words are taken by")

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in batch]
        if len(self.new) > CACHE // 2:
            self.old, self.new = self.new, {}
        new, old, fresh = self.new, self.old, []
        for w in set().union(*cut):
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    fresh.append(w)
        if fresh:
            self._encode_words(fresh)
        get = new.__getitem__
        return [b"".join(map(get, words)) for words in cut]


    def _encode_words(self, fresh: list[str]) -> None:
        """Plain words part by part; other words in composed form go to the library as one text, which is cut again by the
        places of the tokens; the rest go one by one, as normalisation may move their places."""
        new, others, parts, match = self.new, [], self.parts, _PLAIN.fullmatch
        if len(parts) > PARTS:
            parts.clear()
        for w in fresh:
            m = match(w)
            if m is None or "<|" in w:
                others.append(w)
                continue
            before, letters, after = m.groups()
            own = parts.get(letters)
            if own is None:
                own = parts[letters] = self._model_ids(letters.lower())
            for mark in (before, after):
                if mark and mark not in parts:
                    parts[mark] = self._model_ids(mark)
            new[w] = (parts[before] if before else b"") + own + (parts[after] if after else b"")
        plain = [w for w in others if is_normalized("NFC", w)]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            cuts = np.searchsorted(places, starts).tolist()
            data = np.asarray(found.ids, "<u4").tobytes()
            for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                new[w] = data[4 * a : 4 * b]
        rest = [w for w in others if not is_normalized("NFC", w)]
        for w, e in zip(rest, self.library.encode_batch(rest, add_special_tokens=False), strict=True):
            new[w] = np.asarray(e.ids, "<u4").tobytes()

    def _model_ids(self, part: str) -> bytes:
        """Ids of one pre-token, by the library's model; its byte-level alphabet leaves ASCII as it is."""
        mapped = part if part.isascii() else part.translate(self.alphabet)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])


_encoders: dict[str, WordEncoder] = kept.setdefault("tokens", {})


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- the coding --------------------------------------------------------------

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit unsigned values."""
    v = np.ascontiguousarray(values, "<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = length - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8)[None] < length[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack()."""
    length = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8)[None] < length[:, None]] = data
    return out.reshape(-1).view("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def block_bytes(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    flags = np.asarray([d is None for d in doc_ids], np.uint8)
    return b"".join([np.asarray([len(doc_ids), len(ranks), len(data)], "<i8").tobytes(), np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(), flags.tobytes(), np.asarray(counts, "<i8").tobytes(), control, data])


def read_blocks(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, values a document, ranks) of each block of an open file."""
    if source.read(8) != MAGIC:
        raise ValueError("not a token file")
    while head := source.read(24):
        n, m, size = np.frombuffer(head, "<i8").tolist()
        ids, flags, counts = np.frombuffer(source.read(8 * n), "<i8").tolist(), source.read(n), np.frombuffer(source.read(8 * n), "<i8")
        control = np.frombuffer(source.read(-(-m // 4)), np.uint8)
        yield [None if f else d for d, f in zip(ids, flags, strict=True)], counts, unpack(control, np.frombuffer(source.read(size), np.uint8), m)


# --- the operator ------------------------------------------------------------


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, bytes of text and packed ids of every document; written out once, as two passes read it."""

    def make():
        own = encoder(path)
        end, squeeze = np.asarray([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=1).compress

        def each(batch):
            ids = [b + end for b in own.encode_batch(texts(batch))]
            small = [x.astype("<u2") if (x := np.frombuffer(b, "<u4")).max() < 1 << 16 else x for b in ids]
            packed = [(b"2" if x.itemsize == 2 else b"4") + squeeze(x.tobytes()) for x in small]
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), size, pa.array(packed, pa.binary())], ["doc_id", "size", "ids"])

        return each

    return written(map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, "doc_id long, size long, ids binary", "tokens"), "ids")


def _open(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), "<u2" if packed[:1] == b"2" else "<u4").astype(np.uint32)


def frequencies(encoded: DataFrame) -> DataFrame:
    """id and n, how often it occurs in all documents."""

    def run(batches):
        total, held = np.zeros(0, np.int64), []
        for batch in batches:
            for packed in batch["ids"].to_pylist():
                held.append(_open(packed))
            if not held:
                continue
            own = np.bincount(np.concatenate(held), minlength=len(total))
            held.clear()
            own[: len(total)] += total  # as long as the largest id, which the vocabulary bounds
            total = own
        ids = np.flatnonzero(total)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranking(encoded: DataFrame) -> np.ndarray:
    """rank -> id; as many entries as the vocabulary has, which bounds it."""
    rows = frequencies(encoded).collect()
    return np.asarray([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_files(encoded: DataFrame, ranks: np.ndarray, folder: str, file_text: int = FILE_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Write the documents in ascending order; the manifest: part, number, file, n_docs, n_tokens."""

    def run(batches):
        rank_of = np.zeros(int(ranks.max()) + 1, np.uint32)
        rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        file, name, text, docs, tokens = None, "", 0, 0, 0
        doc_ids, counts, own, held = [], [], [], 0

        def flush():
            nonlocal doc_ids, counts, own, held, docs, tokens
            if doc_ids:
                file.write(block_bytes(doc_ids, counts, np.concatenate(own)))
                docs, tokens = docs + len(doc_ids), tokens + held
                doc_ids, counts, own, held = [], [], [], 0

        def close():
            nonlocal file, text, docs, tokens
            if file is not None:
                flush()
                file.close()
                system.move(f"{base}/.{name}", f"{base}/{name}")
                done.append((part, len(done), name, docs, tokens))
                file, text, docs, tokens = None, 0, 0, 0

        for batch in batches:
            for d, size, packed in zip(batch["doc_id"].to_pylist(), batch["size"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if file is None:
                    name = f"{part:08d}-{len(done):06d}-{uuid.uuid4().hex}.ids"
                    file = system.open_output_stream(f"{base}/.{name}")
                    file.write(MAGIC)
                ids = _open(packed)
                doc_ids.append(d)
                counts.append(len(ids))
                own.append(rank_of[ids])
                held, text = held + len(ids), text + size
                if text >= file_text:
                    close()
                elif held >= BLOCK:
                    flush()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "file", "n_docs", "n_tokens"])

    parts = min(most_tasks, max(1, -(-(encoded.agg(F.sum("size")).first()[0] or 0) // file_text)))
    # equal doc_ids may be many: the hash of their ids parts them too
    ordered = encoded.withColumn("mark", F.xxhash64("ids"))
    dealt = ordered.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "ids").select("doc_id", "size", "ids")
    return written(dealt.mapInArrow(run, "part int, number int, file string, n_docs long, n_tokens long"), "manifest")


def read_files(manifest: DataFrame, ranks: np.ndarray, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    # the starts of the parts: one row for each task that wrote, at most MOST_TASKS; those of the files within each part
    starts, total, files = [], 0, 0
    for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).orderBy("part").collect():
        starts.append((r["part"], total))
        total, files = total + r["n"], files + r["files"]
    spark = manifest.sparkSession
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(spark.createDataFrame(starts, "part int, base long")), "part")

    def run(batches):
        system, base = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{name}") as source:
                    for doc_ids, counts, found in read_blocks(source):
                        ids = ranks[found].astype("<u4")
                        ends = np.cumsum(counts)
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])

    return listed.select("file", (F.col("base") + F.col("before")).alias("start")).repartition(max(1, min(files, MOST_TASKS))).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    encoded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ranks = ranking(encoded)
    if not len(ranks):
        return spark.createDataFrame([], SCHEMA)
    return read_files(write_files(encoded, ranks, folder), ranks, folder)
