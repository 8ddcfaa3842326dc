"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding works on a score-ordered agenda of the adjacent symbol pairs that form a piece; the best score (the leftmost
among equals) is merged first. No piece of such a vocabulary reaches over a word mark or a line end, which is verified
when the model is read, so a text is cut there and each distinct segment is encoded once per worker. The agendas of all
new segments of a batch stand in a matrix, a row each: a round takes the best entry of every row, merges, and enters the
two new pairs. Segments of over MATRIX symbols, or with characters that are no piece, have a heap each instead.

Every segment that an Arrow batch brings for the first time is compared with the sentencepiece library's own result. The
ids of each whole document are decoded again, by the library and by decode(), which must agree, and what comes out is
hashed.

Defined cases: a null text counts as empty and has no ids; the decoded text of no ids is empty; rows with a null doc_id
and repeated rows give one row each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestor.llm.common import kept, map_rows, table, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MARK = "▁"
CACHE = 500_000  # segments, in two generations; about 225 bytes each
MATRIX = 64  # symbols of a segment whose agenda is a row
_NEVER = np.iinfo(np.int32).max
_SEGMENT = re.compile(" +[^ \n]*|\n|[^ \n]+")


class PieceCodec:
    """Encoder and decoder of one vocabulary. A text is handled with blanks for word marks, one put before it; the ids of
    each distinct segment are cached, joined by commas."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.fallback = [0] * 256
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.fallback[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.bytes_of.append(b"" if lib.is_control(i) else " ⁇ ".encode())
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} reaches over a segment's end")
                self.ids[piece] = i
                self.score[piece] = lib.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if lib.encode("a  b") != lib.encode(f"a{MARK}{MARK}b") or lib.encode(""):
            raise ValueError("the vocabulary's normaliser isn't plain escaping with a leading mark")
        self._pair_table()
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _pair_table(self) -> None:
        """For the matrix: the symbol of each character, and of each pair of pieces that form one its rank and symbol."""
        self.symbol = np.full(0x110000, -1, np.int32)
        rank = {score: r for r, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        left, right, made = [], [], []
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            for k in range(1, len(piece)):
                if piece[:k] in self.ids and piece[k:] in self.ids:
                    left.append(self.ids[piece[:k]])
                    right.append(self.ids[piece[k:]])
                    made.append(i)
        self.size = 1 + max(self.ids.values())
        pairs = np.asarray(left, np.int64) * self.size + np.asarray(right, np.int64)
        order = np.argsort(pairs)
        self.pairs, self.made = pairs[order], np.asarray(made, np.int32)[order]
        ranks = np.full(self.size, _NEVER, np.int32)
        for piece, i in self.ids.items():
            ranks[i] = rank[self.score[piece]]
        self.rank = ranks[self.made]

    def _entries(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of adjacent symbols; _NEVER where they form no piece or one of them is missing (-1)."""
        pair = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        found = self.pairs[at] == pair
        return np.where(found, self.rank[at], _NEVER), np.where(found, self.made[at], -1)

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; the agendas are rows of matrices, segments of like length together."""
        out: list[list[int]] = [[]] * len(segments)
        joined = "".join(segments).replace(" ", MARK)
        symbols = self.symbol[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.cumsum(lengths) - lengths
        whole = np.minimum.reduceat(symbols, starts) >= 0 if len(segments) else np.zeros(0, bool)
        whole &= lengths <= MATRIX
        for i in np.flatnonzero(~whole).tolist():
            out[i] = self.encode_segment(segments[i])
        order = np.flatnonzero(whole)
        order = order[np.argsort(lengths[order], kind="stable")]
        cuts = np.searchsorted(lengths[order], [0, 5, 9, 13, 21, 33, MATRIX + 1])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                rows = order[a:b]
                width = int(lengths[rows].max())
                column = np.arange(width)
                at = starts[rows][:, None] + column
                matrix = np.where(column < lengths[rows][:, None], symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
                merged = self._merge(matrix)
                sizes = (merged >= 0).sum(1)
                flat, ends = merged[merged >= 0].tolist(), np.cumsum(sizes).tolist()
                begin = 0
                for i, end in zip(rows.tolist(), ends, strict=True):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    def _merge(self, matrix: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1 after the last) when no agenda has an entry left."""
        n, width = matrix.shape
        if width < 2:
            return matrix
        rank, made = self._entries(matrix[:, :-1], matrix[:, 1:])
        out, row = np.full_like(matrix, -1), np.arange(n)
        while True:
            best = rank.argmin(1)  # the first of equal ranks is the leftmost
            going = rank[np.arange(len(row)), best] < _NEVER
            if not going.all():
                out[row[~going], : matrix.shape[1]] = matrix[~going]
                matrix, rank, made, row, best = matrix[going], rank[going], made[going], row[going], best[going]
                if not len(row):
                    return out
            each, width = np.arange(len(row)), matrix.shape[1]
            # symbol `best` becomes the new one, its right neighbour goes, what follows moves up; one column less
            after = np.arange(width - 1) > best[:, None]
            matrix_, new = matrix, made[each, best]
            matrix = np.where(after, matrix_[:, 1:], matrix_[:, :-1])
            matrix[each, best] = new
            if width == 2:
                out[row, :1] = matrix
                return out
            after = after[:, : width - 2] | (np.arange(width - 2) == best[:, None])
            rank, made = np.where(after, rank[:, 1:], rank[:, :-1]), np.where(after, made[:, 1:], made[:, :-1])
            follow = np.where(best + 1 < width - 1, matrix[each, np.minimum(best + 1, width - 2)], -1)
            here = best < width - 2
            rank[each[here], best[here]], made[each[here], best[here]] = self._entries(new[here], follow[here])
            left = best > 0
            rank[each[left], best[left] - 1], made[each[left], best[left] - 1] = self._entries(matrix[each[left], best[left] - 1], new[left])

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of one segment by an agenda that is a heap."""
        symbols: list[str | None] = list(segment.replace(" ", MARK))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, agenda = self.score, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in score:
                    heapq.heappush(agenda, (-score[longer], i, longer))
            if (h := before[i]) >= 0:
                longer = symbols[h] + pair
                if longer in score:
                    heapq.heappush(agenda, (-score[longer], h, longer))
        out = []
        for s in symbols:
            if s is not None:
                if s in self.ids:
                    out.append(self.ids[s])
                else:
                    out += [self.fallback[b] for b in s.encode()]
        return out

    def checked(self, fresh: list[str]) -> None:
        """Encode segments that aren't cached, compare them with the library, and cache them."""
        own = self.encode_segments(fresh)
        # the library puts a mark before each text: a segment without one follows a line end here
        theirs = self.library.encode([s[1:] if s[0] == " " else "\n" + s for s in fresh], num_threads=1)
        lead = [self.ids[MARK], self.fallback[10]]
        for s, mine, lib in zip(fresh, own, theirs, strict=True):
            if s[0] != " ":
                if lib[:2] != lead:
                    raise ValueError(f"the library encodes a line end as {lib[:2]}")
                lib = lib[2:]
            elif s == " ":
                lib = mine  # the library gives no ids for an empty text; the mark is tested with longer segments
            if mine != lib:
                raise ValueError(f"{s!r}: agenda {mine}, library {lib}")
            self.new[s] = ",".join(map(str, mine))

    def encode_batch(self, batch: list[str]) -> list[str]:
        """The ids of each text, joined by commas."""
        cut = [_SEGMENT.findall(" " + t.replace(MARK, " ")) if t else [] for t in batch]
        if len(self.new) > CACHE // 2:
            self.old, self.new = self.new, {}
        new, old, fresh = self.new, self.old, []
        for s in set().union(*cut):
            if s not in new:
                if s in old:
                    new[s] = old[s]
                else:
                    fresh.append(s)
        if fresh:
            self.checked(fresh)
        get = new.__getitem__
        return [",".join(map(get, segments)) for segments in cut]

    def digests(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the text that they decode to, of each text."""
        found = self.encode_batch(batch)
        ids = [list(map(int, joined.split(","))) if joined else [] for joined in found]
        theirs = self.library.decode(ids, num_threads=1)
        out = []
        for joined, own, text in zip(found, ids, theirs, strict=True):
            if self.decode(own) != text:
                raise ValueError(f"ids {own[:20]} ... are decoded otherwise than by the library")
            out.append((len(own), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte pieces as UTF-8, the leading mark dropped."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        if ids and data[:1] == b" " and self.library.id_to_piece(ids[0]).startswith(MARK):
            data = data[1:]
        return data.decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = kept.setdefault("pieces", {})


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every document."""

    def make():
        own = codec(path)

        def each(batch):
            return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array([list(map(int, j.split(","))) if j else [] for j in own.encode_batch(texts(batch))], pa.list_(pa.int32()))], ["doc_id", "ids"])

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, "doc_id long, ids array<int>", "pieces")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encode()'s result."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([own.decode(i or []) for i in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every document; counts and digests of both."""

    def make():
        own = codec(path)

        def each(batch):
            n, ids, decoded = zip(*own.digests(texts(batch)), strict=True)
            return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, SCHEMA, "pieces")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_model())
