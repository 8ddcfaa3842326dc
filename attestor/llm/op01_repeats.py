"""Repeated substrings by a run-length index (r-index) over routed pieces of the corpus.

Every byte that a LENGTH-byte string covers which also starts earlier is removed, judged on the input.

1. Routing. Each window of LENGTH bytes has a minimizer: the least hash of its K-byte substrings. Equal windows have
   equal minimizers wherever they stand, so consecutive windows of one minimizer form a segment, and the segments of a
   minimizer hold all occurrences of their windows. Only (minimizer, digest, place) is shuffled, about one row for every
   forty bytes. The digest is xxh3 of 128 bits over the segment's bytes; a segment whose digest occurred earlier is a
   repeat as a whole. Equal segments are pre-aggregated in each slice before the shuffle, so copies do not pile up; what
   that decides goes along in the same rows (`local`), so that both come from one evaluation of one slice.
2. Index. Minimizers with several different segments (or one that may repeat within) get their bytes from documents.
   Pieces of about INDEX_BYTES are indexed: suffix order by prefix doubling, the Burrows-Wheeler transform, its runs,
   and the suffix array at run starts and ends only. From these samples matching statistics are streamed in text order:
   the predecessor sample of a place gives its lexicographic neighbour, and the match length falls by one a place from
   sample to sample. Places that match LENGTH bytes are chained to their neighbour; all but the earliest are repeats.
3. A minimizer with more than HOT different segments is not gathered: its windows are grouped one by one by their
   digest, pre-aggregated, which gives the same repeats for any size of group.
4. Removed ranges are united per document.

Defined cases: a null text counts as empty; rows with a null doc_id lose nothing and make nothing a repeat; rows that
share doc_id stand at the same places, so equal ones don't make each other repeats; further columns are ignored; an
empty table gives an empty result. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import map_rows, mix64, prefix_hash, slices, table, written

LENGTH, K = 100, 24
W = LENGTH - K + 1  # K-byte substrings of a window
MOST = 1024  # windows of a segment
INDEX_BYTES, HOT = 2 << 20, 20_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _buffer(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row bounds)."""
    column = batch[name].fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the 128-bit xxh3 of data[begin:end], for each pair."""
    view, take = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([take(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), ">u8").reshape(-1, 2)
    return found[:, 0].astype(np.uint64), found[:, 1].astype(np.uint64)


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, minimizer, digest in two halves, may repeat within) of each segment of each row."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, bool),)
    if len(data) < LENGTH:
        return none
    sums, inverse = prefix_hash(data)
    n = len(data)
    h = mix64((sums[K:] - sums[:-K]) * inverse[: n - K + 1])
    least = _sliding(h, W, np.minimum)  # of each window
    row = np.searchsorted(bounds, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + LENGTH <= bounds[row + 1]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(change & inside)
    if not len(begin):
        return none
    # the windows of a segment end with the run, or where the row has no more windows
    runs = np.flatnonzero(change)
    end = np.append(runs, len(least))[np.searchsorted(runs, begin, "right")]
    end = np.minimum(end, bounds[row[begin] + 1] - LENGTH + 1)
    pieces = -(-(end - begin) // MOST)
    if pieces.max() > 1:
        which = np.repeat(np.arange(len(begin)), pieces)
        part = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = begin[which] + part * MOST, np.minimum(end[which], begin[which] + (part + 1) * MOST)
    minimizer = least[begin]
    digest = digests(data, begin, end + LENGTH - 1)
    # a window can repeat within a segment only if the minimizer occurs there twice
    padded = np.concatenate([np.zeros(W - 1, np.uint64), least, np.zeros(W - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, W, np.maximum) == h)
    values = h[places]
    low, high = np.searchsorted(places, begin), np.searchsorted(places, end + W - 1)
    twice = high - low > 8
    times = np.zeros(len(begin), np.int64)
    for t in range(8):
        at = low + t
        times += (at < high) & (values[np.minimum(at, len(values) - 1)] == minimizer)
    own = row[begin]
    return own, begin - bounds[own], end - begin, minimizer, *digest, twice | (times > 1)


def _in_slice(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc_id, start, windows, minimizer, digest halves, within, and whether an equal segment stands earlier in the slice."""
    row, start, windows, minimizer, high, low, within = segments(*_buffer(batch))
    doc = np.asarray(batch["doc_id"].cast(pa.int64()))[row] if len(row) else np.zeros(0, np.int64)
    order = np.lexsort((start, doc, low, high, minimizer))
    doc, start, windows, minimizer, high, low, within = (x[order] for x in (doc, start, windows, minimizer, high, low, within))
    same = np.zeros(len(doc), bool)
    same[1:] = (minimizer[1:] == minimizer[:-1]) & (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    place = np.ones(len(doc), bool)
    place[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    fresh = ~same | place  # the same place again (a repeated row) is dropped
    later = same & place
    # after a repeated row of the first place, a later one is still later; a repeat of the first place is not
    return tuple(x[fresh] for x in (doc, start, windows, minimizer, high, low, within, later))


def _rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _places(docs: DataFrame) -> DataFrame:
    """For the shuffle, from one evaluation of each slice: its first segments (`size` is windows, negative if one may
    repeat within), and, as local rows dealt by document, the united ranges that repeat an earlier segment of the slice."""

    def make():
        def each(batch):
            doc, start, windows, minimizer, high, low, within, later = _in_slice(batch)
            keep = ~later
            own, a, b = (np.asarray(c) for c in _united(doc[later], start[later], start[later] + windows[later] + LENGTH - 1).columns)
            none = np.zeros(len(own), np.uint64)
            columns = {
                "m": (minimizer[keep], mix64(own.astype(np.uint64))), "g": (high[keep], none), "h": (low[keep], none), "doc_id": (doc[keep], own), "start": (start[keep], a),
                "size": (np.where(within, -windows, windows)[keep], b - a - (LENGTH - 1)), "local": (np.zeros(int(keep.sum()), bool), np.ones(len(own), bool)),
            }
            return _rows({k: np.concatenate(v) for k, v in columns.items()})

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, "m long, g long, h long, doc_id long, start long, size long, local boolean")


def _united(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if len(doc):
        # ends never fall within a document by more than a segment, so a running maximum per document is exact
        new = np.ones(len(doc), bool)
        top = np.maximum.accumulate(b + np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]])) * (1 << 40)) & ((1 << 40) - 1)
        new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > top[:-1])
        first = np.flatnonzero(new)
        doc, a, b = doc[first], a[first], top[np.append(first[1:], len(top)) - 1]
    return _rows({"doc_id": doc, "a": a, "b": b})


def _judge(batches):
    """Over rows sorted by (m, g, h, doc_id, start): whole == True marks a segment whose bytes occurred earlier, whole ==
    False the first of its bytes where the minimizer has other segments too, or may repeat within. Local rows are whole."""
    names = ("m", "g", "h", "doc_id", "start", "size")
    held = None  # the only segment of its minimizer so far
    last = None  # (m, g, h, doc_id, start) of the last row
    for batch in batches:
        local = np.asarray(batch["local"])
        every = [np.asarray(batch[c]) for c in names]
        out, flags = [tuple(every[k][local] for k in (0, 3, 4, 5))], [True]
        m, g, h, doc, start, size = (x[~local] for x in every)
        if len(m):
            new_m, new_g, again = np.ones(len(m), bool), np.ones(len(m), bool), np.zeros(len(m), bool)
            new_m[1:] = m[1:] != m[:-1]
            new_g[1:] = new_m[1:] | (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            again[1:] = ~new_g[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
            if last is not None:
                new_m[0] = m[0] != last[0]
                new_g[0] = new_m[0] or (g[0], h[0]) != last[1:3]
                again[0] = not new_g[0] and (doc[0], start[0]) == last[3:]
            whole = ~new_g & ~again
            first = np.flatnonzero(new_g)
            # a first segment is wanted if its minimizer has another first segment before or after it
            wanted = ~new_m[first]
            wanted[:-1] |= ~new_m[first[1:]]
            alone = first[~wanted & (size[first] < 0)]
            rows = (m, doc, start, np.abs(size))
            out += [tuple(x[whole] for x in rows), tuple(x[first[wanted]] for x in rows), tuple(x[alone] for x in rows)]
            flags += [True, False, False]
            if held is not None and len(first) and not new_m[first[0]]:
                out.append(tuple(np.asarray([x]) for x in held))
                flags.append(False)
            if len(first):
                i = first[-1]
                # the last first segment may get company in the next batch, unless it has gone out already
                held = (m[i], doc[i], start[i], abs(size[i])) if not wanted[-1] and size[i] > 0 else None
            last = (m[-1], g[-1], h[-1], doc[-1], start[-1])
        yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([p[k] for p in out])) for k in range(4)), pa.array(np.repeat(flags, [len(p[0]) for p in out]))], ["m", "doc_id", "start", "size", "whole"])


# --- the index ---------------------------------------------------------------


class RunIndex:
    """Run-length index of pieces of text: suffix array samples at the ends of the runs of the transform only."""

    def __init__(self, pieces: list[bytes]):
        self.text = np.frombuffer(b"".join(p + b"\0" * 8 for p in pieces), np.uint8)  # eight bytes for whole-word reads
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths + 8) - lengths - 8
        # symbols: the bytes of the pieces and one end each; places are places in self.text
        place = np.repeat(starts - (np.cumsum(lengths + 1) - lengths - 1), lengths + 1) + np.arange(int((lengths + 1).sum()))
        self.ends = np.repeat(starts + lengths, lengths + 1)  # end of the piece of each symbol
        self.place = place
        order = self._suffix_order(place, self.ends)
        symbol = np.where(place < self.ends, self.text[place].astype(np.int64) + 1, 0)
        before = np.where(np.concatenate([[True], place[1:] != place[:-1] + 1]), 0, np.concatenate([[0], symbol[:-1]]))
        transform = before[order]
        # runs of the transform; symbol 0 (a piece's start) is a run of its own each time
        head = np.ones(len(order), bool)
        head[1:] = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
        heads = np.flatnonzero(head)
        self.runs = len(heads)
        heads = heads[heads > 0]
        at, neighbour = order[heads], order[heads - 1]  # sampled run start and the end of the run before it
        by_place = np.argsort(at)
        self.sample, self.neighbour = at[by_place], neighbour[by_place]
        self.length = self._match(self.sample, self.neighbour)

    def _suffix_order(self, place: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(place)
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        words = np.zeros(n, np.uint64)
        for k in range(8):
            inside = place + k < ends
            words = (words << np.uint64(8)) | np.where(inside, padded[place + k], 0).astype(np.uint64)
        left = np.minimum(ends - place, 8).astype(np.uint64)  # tells an end from a zero byte
        ended = left < 8
        # ends are told apart by their place, so that suffixes up to an end differ
        order = np.lexsort((np.where(ended, np.arange(n), 0), left, words))
        sorted_words, sorted_left = words[order], left[order]
        new = np.ones(n, bool)
        new[1:] = (sorted_words[1:] != sorted_words[:-1]) | (sorted_left[1:] != sorted_left[:-1]) | (sorted_left[1:] < 8)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        step = 8
        while True:
            open_ = ~(new & np.append(new[1:], True))
            if not open_.any():
                return order
            slots = np.flatnonzero(open_)
            members = order[slots]
            # unresolved suffixes are longer than step, so members + step stays within the same piece
            key = rank[members] * (n + 1) + rank[np.minimum(members + step, n - 1)]
            by = np.argsort(key)
            members, key = members[by], key[by]
            order[slots] = members
            fresh = np.ones(len(slots), bool)
            fresh[1:] = key[1:] != key[:-1]
            new[slots] = fresh
            rank[members] = np.maximum.accumulate(np.where(fresh, slots, 0))
            step *= 2

    def _match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at symbols i and j, within their pieces."""
        most = np.minimum(self.ends[i] - self.place[i], self.ends[j] - self.place[j])
        a, b = self.place[i], self.place[j]
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.text, np.zeros(8, np.uint8)]), 8)
        out, active = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        while len(active):
            at = out[active]
            differ = view[a[active] + at] != view[b[active] + at]
            any_ = differ.any(1)
            gain = np.where(any_, differ.argmax(1), 8)
            out[active] = at + gain
            active = active[~any_ & (out[active] < most[active])]
        return np.minimum(out, most)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(neighbour, length) of every symbol in text order: the suffix just before it in the order, and their match."""
        n = len(self.place)
        if not len(self.sample):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.searchsorted(self.sample, np.arange(n), "right") - 1
        away = np.arange(n) - self.sample[np.maximum(at, 0)]
        length = np.where(at >= 0, np.maximum(self.length[np.maximum(at, 0)] - away, 0), 0)
        return np.where(length > 0, self.neighbour[np.maximum(at, 0)] + away, 0), length

    def repeats(self, least: int = LENGTH) -> np.ndarray:
        """For every symbol, whether the `least` bytes from there also start at an earlier symbol."""
        neighbour, length = self.matching_statistics()
        chained = length >= least
        root = np.where(chained, neighbour, np.arange(len(chained)))
        while True:
            new = root[root]
            if np.array_equal(new, root):
                break
            root = new
        earliest = np.arange(len(root))
        member = np.flatnonzero(chained)
        np.minimum.at(earliest, root[member], member)
        return earliest[root] < np.arange(len(root))


def _index_marks(rows: DataFrame) -> DataFrame:
    """Over (m, doc_id, start, body) sorted by m, doc_id, start: ranges found by indexes of about INDEX_BYTES each."""

    def found(pieces, doc, start):
        repeat = RunIndex(pieces).repeats()
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        piece = np.repeat(np.arange(len(pieces)), lengths)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hit = np.flatnonzero(repeat)
        a = np.asarray(start)[piece[hit]] + within[hit]
        return _united(np.asarray(doc)[piece[hit]], a, a + LENGTH)

    def run(batches):
        pieces, doc, start, size, last = [], [], [], 0, None
        for batch in batches:
            for m, d, s, body in zip(*(batch[c].to_pylist() for c in ("m", "doc_id", "start", "body")), strict=True):
                if size >= INDEX_BYTES and m != last:  # a minimizer stays in one index
                    yield found(pieces, doc, start)
                    pieces, doc, start, size = [], [], [], 0
                pieces.append(body)
                doc.append(d)
                start.append(s)
                size += len(body)
                last = m
        if pieces:
            yield found(pieces, doc, start)

    return rows.mapInArrow(run, "doc_id long, a long, b long")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """m, doc_id, start, hot and the bytes of the wanted segments."""
    own = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("m", "start", "size", "hot")).alias("_wanted")).withColumnRenamed("doc_id", "_id")
    both = docs.select(docs["doc_id"], docs["text"]).join(own, docs["doc_id"] == F.col("_id")).select("doc_id", "text", "_wanted")

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text, asked in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["_wanted"].to_pylist(), strict=True):
                data = (text or "").encode()
                rows += [(w["m"], doc_id, w["start"], w["hot"], data[w["start"] : w["start"] + w["size"] + LENGTH - 1]) for w in asked]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["m", "doc_id", "start", "hot", "body"])

    return both.mapInArrow(run, "m long, doc_id long, start long, hot boolean, body binary")


def _hot_marks(bodies: DataFrame) -> DataFrame:
    """Ranges of single windows that occurred earlier, by their digests; for minimizers too frequent for one index."""

    def run(batches):
        for batch in batches:
            bodies_ = batch["body"].to_pylist()
            data = np.frombuffer(b"".join(bodies_), np.uint8)
            lengths = np.fromiter(map(len, bodies_), np.int64, len(bodies_))
            if not len(data):
                continue
            piece = np.repeat(np.arange(len(lengths)), lengths)
            within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.flatnonzero(within + LENGTH <= lengths[piece])
            high, low = digests(data, at, at + LENGTH)
            yield _rows({"g": high, "h": low, "m": np.asarray(batch["m"])[piece[at]], "doc_id": np.asarray(batch["doc_id"])[piece[at]], "start": np.asarray(batch["start"])[piece[at]] + within[at]})

    windows = bodies.select("m", "doc_id", "start", "body").mapInArrow(run, "g long, h long, m long, doc_id long, start long")
    first = windows.groupBy("g", "h", "m").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(first, ["g", "h", "m"]).where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))


def marks(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, a, b: byte ranges to remove; they may overlap."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("doc_id is not null and text is not null")
    dealt = _places(docs).repartition(F.col("m")).sortWithinPartitions("m", "g", "h", "doc_id", "start")
    judged = written(dealt.mapInArrow(_judge, "m long, doc_id long, start long, size long, whole boolean"), "judged")
    firsts = judged.where("not whole")
    frequent = firsts.groupBy("m").agg(F.count("*").alias("n")).where(f"n > {hot}").select("m", F.lit(True).alias("hot"))
    bodies = written(_bodies(docs, firsts.join(frequent, "m", "left").select("m", "doc_id", "start", "size", F.coalesce("hot", F.lit(False)).alias("hot"))), "bodies")
    indexed = _index_marks(bodies.where("not hot").select("m", "doc_id", "start", "body").repartition(F.col("m")).sortWithinPartitions("m", "doc_id", "start"))
    whole = judged.where("whole").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("size") + (LENGTH - 1)).alias("b"))
    out = whole.unionByName(indexed)
    if not frequent.isEmpty():
        out = out.unionByName(_hot_marks(bodies.where("hot")))
    return out


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text without the removed bytes as binary, and counts, of every row of docs."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    cut = marks(docs, hot).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("_cut")).withColumnRenamed("doc_id", "_id")
    both = own.join(cut, own["doc_id"] == F.col("_id"), "left").select("doc_id", "text", "_cut")

    def run(batches):
        for batch in slices(batches):
            rows = []
            lists = batch["_cut"]
            for i, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                data = (text or "").encode()
                spans: list[list[int]] = []
                if lists[i].is_valid:
                    own_ = lists[i].values
                    a, b = np.asarray(own_.field("a")), np.asarray(own_.field("b"))
                    order = np.argsort(a)
                    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        if spans and x <= spans[-1][1]:
                            spans[-1][1] = max(y, spans[-1][1])
                        else:
                            spans.append([x, y])
                kept, at = [], 0
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((doc_id, len(data), len(data) - len(rest), len(spans), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
