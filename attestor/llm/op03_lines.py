"""Quality rules by line labelling: a linear-chain conditional random field, decoded by Viterbi.

Each line of a document is labelled content or boilerplate. The field is trained here on a bounded sample of the
labelled documents (SAMPLE_DOCS documents of at most SAMPLE_LINES lines, the smallest by a hash of doc_id). Labels are of
documents, so those of their lines are learned along (multiple instances): at first each line has its document's label;
then, ROUNDS times, a line of a bad document becomes content if by its features alone it looks like content, but for the
line that looks least like it, and a line of a good document becomes boilerplate if it clearly looks like that, for at
most half of its words; and the field is fitted again. So transitions are learned from labels that change within
documents. The field is then applied to every line of every whole text. The share of words on content lines decides
retention; the least share is the one that parts the sample's good and bad documents best (CONTENT_SHARE if none does).

Defined cases: a null or blank text has no words, fails the base rules and isn't kept; rows with a null doc_id and
repeated rows are judged like any other, each giving one row; further columns are ignored; an empty table gives an
empty result. Without labelled documents of both kinds the field has zero weights and labels every line content.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import map_rows, slices, texts

SAMPLE_DOCS, SAMPLE_LINES, STEPS, ROUNDS = 1500, 60, 60, 2
MIN_WORDS, CONTENT_SHARE, CLEAR = 50, 0.5, 1.0
SHARES = tuple(k / 20 for k in range(6, 20))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_words long"

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SYMBOLS = "#*$%&|<>"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_STOP = tuple('.!?:;"”»)')

#: Upper bounds of the buckets of each numeric feature; a value falls into the first bucket whose bound exceeds it.
BUCKETS = {
    "words": (1, 2, 5, 10, 25),
    "symbol_share": (0.001, 0.01, 0.04, 0.1),
    "capital_share": (0.02, 0.1, 0.3, 0.6),
    "digit_share": (0.001, 0.05, 0.2),
    "distinct_share": (0.2, 0.4, 0.6, 0.8),
    "word_length": (2.5, 4, 6, 8, 12),
    "repeat_share": (0.001, 0.05, 0.25, 0.5),
}
_OFFSETS = dict(zip(BUCKETS, np.cumsum([0] + [len(b) + 1 for b in BUCKETS.values()])[:-1].tolist(), strict=True))
_FLAGS = sum(len(b) + 1 for b in BUCKETS.values())
N_FEATURES = _FLAGS + 4  # ends a sentence or not, seen before in the document or not
N_ACTIVE = len(BUCKETS) + 2


def _bucket(name: str, value: float) -> int:
    for i, bound in enumerate(BUCKETS[name]):
        if value < bound:
            return _OFFSETS[name] + i
    return _OFFSETS[name] + len(BUCKETS[name])


def line_features(text: str) -> tuple[list[list[int]], list[int]]:
    """(active features, words) of each \\n-split line of a text."""
    found, sizes, seen = [], [], set()
    for line in text.split("\n"):
        own = line.encode().split()
        n = len(own)
        chars = max(1, sum(map(len, own)))
        letters = len(line) or 1
        capitals = sum(map(str.isupper, line)) if n and line != line.lower() else 0
        digits = sum(map(line.count, "0123456789"))
        repeats = sum(a == b for a, b in zip(own, own[1:], strict=False))
        found.append([
            _bucket("words", n),
            _bucket("symbol_share", sum(map(line.count, _SYMBOLS)) / letters),
            _bucket("capital_share", capitals / letters),
            _bucket("digit_share", digits / letters),
            _bucket("distinct_share", len(set(own)) / n if n else 1.0),
            _bucket("word_length", chars / n if n else 0.0),
            _bucket("repeat_share", repeats / n if n else 0.0),
            _FLAGS + line.rstrip().endswith(_STOP),
            _FLAGS + 2 + (n > 0 and line in seen),
        ])
        if n:
            seen.add(line)
        sizes.append(n)
    return found, sizes


class LineField:
    """A linear-chain conditional random field over two labels: 0 boilerplate, 1 content."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, share: float = CONTENT_SHARE):
        self.emit, self.step, self.share = emit, step, share  # [features, 2], [2, 2], least share of words on content lines

    @classmethod
    def zero(cls) -> LineField:
        return cls(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))

    @classmethod
    def fit(cls, documents: list[list[list[int]]], labels: list[int], of_lines: list[list[int]] | None = None, steps: int = STEPS, rate: float = 0.1, l2: float = 1e-3) -> LineField:
        """Maximum likelihood by Adam; forward-backward over all sequences at once, padded to the longest. of_lines: labels
        of the lines, those of their documents if none are given."""
        n, longest = len(documents), max(map(len, documents))
        feats = np.zeros((n, longest, N_ACTIVE), np.int64)
        here = np.zeros((n, longest), bool)
        for i, lines in enumerate(documents):
            feats[i, : len(lines)] = lines
            here[i, : len(lines)] = True
        gold = np.asarray(labels)
        target = np.zeros((n, longest, 2))
        for i, y in enumerate(labels):
            own = of_lines[i] if of_lines is not None else [y] * len(documents[i])
            target[i, np.arange(len(own)), own] = 1.0
        params = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2))]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        # balance the two kinds of documents, as most labelled ones are good
        weight = np.where(gold == 1, 0.5 / max(1, (gold == 1).sum()), 0.5 / max(1, (gold == 0).sum()))
        for t in range(1, steps + 1):
            emit, step = params
            score = emit[feats].sum(2)  # [n, longest, 2]
            forward, backward = np.zeros_like(score), np.zeros_like(score)
            forward[:, 0] = score[:, 0]
            for k in range(1, longest):
                new = np.logaddexp.reduce(forward[:, k - 1, :, None] + step[None], axis=1) + score[:, k]
                forward[:, k] = np.where(here[:, k, None], new, forward[:, k - 1])
            for k in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(step[None] + (score[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
                backward[:, k] = np.where(here[:, k + 1, None], new, 0.0)
            total = np.logaddexp.reduce(forward[:, -1], axis=1)
            node = np.exp(forward + backward - total[:, None, None]) * here[:, :, None]
            grad_emit, grad_step = np.zeros_like(emit), np.zeros_like(step)
            slack = (target - node) * weight[:, None, None] / here.sum(1)[:, None, None]
            for j in range(N_ACTIVE):
                for y in (0, 1):
                    grad_emit[:, y] += np.bincount(feats[:, :, j].ravel(), slack[:, :, y].ravel(), N_FEATURES)
            if longest > 1:
                pair = np.exp(forward[:, :-1, :, None] + step[None, None] + (score + backward)[:, 1:, None, :] - total[:, None, None, None])
                pair *= (here[:, 1:] * (weight / here.sum(1))[:, None])[:, :, None, None]
                seen = target[:, :-1, :, None] * target[:, 1:, None, :] * (weight / here.sum(1))[:, None, None, None]
                grad_step += (seen - pair).sum((0, 1))
            for p, g, a, b in zip(params, (grad_emit, grad_step), m, v, strict=True):
                g = g - l2 * p
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return cls(*params)

    @classmethod
    def learn(cls, documents: list[list[list[int]]], sizes: list[list[int]], labels: list[int], rounds: int = ROUNDS) -> LineField:
        """Fit with the labels of documents, then of lines as they are found; sizes: words of each line."""
        field, own = cls.fit(documents, labels), None
        for _ in range(rounds):
            own = [field.line_labels(lines, n, y) for lines, n, y in zip(documents, sizes, labels, strict=True)]
            field = cls.fit(documents, labels, own)
        shares = np.asarray([sum(s for s, y in zip(n, field.viterbi(lines), strict=True) if y) / max(1, sum(n)) for lines, n in zip(documents, sizes, strict=True)])
        gold = np.asarray(labels)
        # of equal ones the share nearest to CONTENT_SHARE
        best = max(((shares[gold == 1] >= t).mean() + (shares[gold == 0] < t).mean(), -abs(t - CONTENT_SHARE), t) for t in SHARES)
        field.share = best[2] if best[0] > 1 else CONTENT_SHARE
        return field

    def line_labels(self, lines: list[list[int]], sizes: list[int], label: int) -> list[int]:
        """Labels of the lines of a labelled document, by their features alone."""
        margin = self.emit[np.asarray(lines)].sum(1) @ np.array([-1.0, 1.0])
        if label == 0:
            out = (margin > 0).astype(int)
            out[np.where(np.asarray(sizes) > 0, margin, np.inf).argmin()] = 0
            return out.tolist()
        out, left = np.ones(len(lines), int), sum(sizes) / 2
        for i in np.argsort(margin).tolist():
            if margin[i] >= -CLEAR or sizes[i] > left:
                break
            out[i], left = 0, left - sizes[i]
        return out.tolist()

    def viterbi(self, lines: list[list[int]]) -> list[int]:
        """The best label sequence; ties go to content."""
        if not lines:
            return []
        score = self.emit[np.asarray(lines)].sum(1).tolist()
        (t00, t01), (t10, t11) = self.step.tolist()
        (a, b), back = score[0], []
        for s0, s1 in score[1:]:
            from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00) + s0, (b + t11 if from1 else a + t01) + s1
        label = int(b >= a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    own = text.encode().split()
    n = len(own)
    symbols = sum(map(text.count, _SYMBOLS))
    lines = text.split("\n")
    duplicates = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                duplicates += 1
            elif line.encode().split():
                seen.add(line)
    repeats = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        x = np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int64, n)
        _, pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)
        _, window, count = np.unique(pair[:-1] * len(ids) + x[2:], return_inverse=True, return_counts=True)
        twice = count[window] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeats = int(covered.sum())
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, len(text) - spaces, symbols, duplicates, repeats


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> LineField:
    """Fit the field on a bounded sample of labelled documents, chosen by a hash of doc_id."""
    known = labels.select(labels["doc_id"], labels["quality"]).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # a third of the sample is of the rarer kind, if there is as much
    picked = known.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 3).unionByName(known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample - sample // 3))
    rows = (
        docs.select(docs["doc_id"], docs["text"])
        .where("text is not null")
        .join(F.broadcast(picked), "doc_id", "left_semi")  # at most `sample` ids
        .where(F.size(F.split("text", "\n")) <= lines)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
        .orderBy("doc_id").limit(sample)
        .collect()
    )
    labels_ = [int(r["quality"]) for r in rows]
    if len(set(labels_)) < 2:
        return LineField.zero()
    documents, sizes = zip(*(line_features(r["text"]) for r in rows), strict=True)
    return LineField.learn(list(documents), list(sizes), labels_)


def label_lines(docs: DataFrame, field: LineField) -> DataFrame:
    """One row for each document: the base counts, the base rules, content words by Viterbi, and the verdict."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts(batch):
                n, chars, symbols, duplicates, repeats = base_counts(text)
                lines, sizes = line_features(text)
                content = sum(s for s, y in zip(sizes, field.viterbi(lines), strict=True) if y)
                failed = n < MIN_WORDS or 100 * repeats > 50 * n
                rows.append((n, chars, symbols, duplicates, repeats, failed, not failed and content >= field.share * n, len(lines), content))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, SCHEMA)


def keep_good(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of docs, all columns, that the base rules and the field keep."""
    schema = docs.schema

    def run(batches):
        for batch in slices(batches):
            keep = []
            for text in texts(batch):
                n, _, _, _, repeats = base_counts(text)
                good = n >= MIN_WORDS and 100 * repeats <= 50 * n
                if good:
                    lines, sizes = line_features(text)
                    good = sum(s for s, y in zip(sizes, field.viterbi(lines), strict=True) if y) >= field.share * n
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return label_lines(docs, train(spark, docs, table(spark, sf_dir, "labels")))
