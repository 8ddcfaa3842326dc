"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Base spans are the matches of four fixed patterns and their checks; they are always reported. Candidate spans are
looser: digit groups, dotted groups, plus-numbers, spelled-out addresses, and runs of letters and digits that may be a
key, token or password (kind `secret`, which has no base pattern). Five labelers vote for, against or not at all on each
candidate: the strict pattern with its check, a gazetteer (number prefixes, address endings, key prefixes), words before
the span, words that speak against it, and its shape (grouping of digits, mixture of letters and digits).

Votes and a few coarse features of a candidate form a pattern; there are at most some thousand patterns, whatever the
corpus. The counts of the patterns over all candidates of all documents are the only training data:
expectation-maximisation starts from the majority of the votes, estimates each labeler's reliability per kind and the
probability of each pattern, and a logistic classifier over votes and features is fitted to these probabilities. No
labeler is taken to be right: the strict pattern is one vote. Candidates given at least CERTAIN are added, unless they
overlap a base span. Everything that is read covers whole texts, in time proportional to their length.

Defined cases: a null text counts as empty; rows with a null doc_id and repeated rows give one row each; further columns
are ignored; an empty table gives an empty result; without candidates the classifier adds nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import map_rows, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELERS = 5
CERTAIN, CONTEXT, STEPS = 0.9, 24, 60
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Gazetteers and context words of the labelers.
ENDINGS = frozenset("com net org edu gov mil int info biz eu de fr es it uk us ca au ch at nl be pt br mx ar io co dev app".split())
CARD_PREFIXES = ("34", "37", "36", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65")
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
FOR = {
    "email": "mail e-mail email correo courriel contact kontakt write",
    "ip": "ip ipv4 host server address adresse serveur dirección logged login",
    "card": "card visa mastercard amex credit karte kreditkarte carte tarjeta payment",
    "secret": "token secret password passwd pwd key apikey api_key api-key access_key auth bearer credential passwort contraseña clave",
    "phone": "phone tel telephone mobile cell call fax telefon telefono téléfono teléfono appel llame whatsapp",
}
AGAINST = "version v release chapter section isbn issn doi figure table page total sum price order invoice id no nr art sha sha1 sha256 md5 commit hash checksum digest build"
KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "ya29.", "eyJ")
KEY_LENGTHS = (20, 32, 36, 40, 44, 48, 56, 64)
_FOR = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, w.split())) + r")\W*$", re.I) for k, w in FOR.items()}
_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST.split()) + r")\W*$", re.I)

_NUMBERS = re.compile(r"\+?\(?[0-9][0-9().\x20/-]{5,30}[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,4}")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{12,}")  # possessive by nature: what follows is never of the class
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    """The matches of EMAIL, found from each @ outwards: linear, where the pattern rescans a long run from each place."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, free
        at = text.find("@", free)


def _addresses(text: str):
    """The matches of IP: each four groups of a chain of dotted groups, in turn."""
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            groups, at = m[0].split("."), m.start()
            for k in range(0, len(groups) - 3, 4):
                four = groups[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in four):
                    yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start: leftmost non-overlapping matches of each pattern that pass its check."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", a, b) for a, b in _addresses(text)]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _kind(span: str, digits: str) -> str | None:
    """The kind that a number looks like."""
    if span[0] != "+" and span.count(".") == 3 and all(0 < len(p) <= 4 for p in re.split(r"\.", span)) and not re.search(r"[^0-9.]", span):
        return "ip"
    if span[0] == "+" and 7 <= len(digits) <= 16:
        return "phone"
    if 15 <= len(digits) <= 19:
        return "card"
    return "phone" if 8 <= len(digits) <= 14 else None


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, pattern) of the base spans and of the looser candidates that overlap none of them, nor each
    other: the leftmost stays, of the same place the longest."""
    found = [(k, a, b, True) for k, a, b in base]
    loose = [("email", m.start(), m.end()) for m in _SPELLED.finditer(text)] if "at" in text and ("[" in text or "(" in text) else []
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            a, b = m.span()
            if kind := _kind(m[0], "".join(_DIGIT.findall(m[0]))):
                loose.append((kind, a, b))
        for m in _KEY.finditer(text):
            if _DIGIT.search(m[0]) and not m[0].replace("-", "").replace("/", "").isdigit() and m[0].upper() != m[0].lower():
                loose.append(("secret", m.start(), m.end()))
    if loose:
        taken = sorted((a, b) for _, a, b in base)
        i, free = 0, 0
        for k, a, b in sorted(loose, key=lambda c: (c[1], -c[2])):
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if a >= free and not (i < len(taken) and taken[i][0] < b):
                found.append((k, a, b, False))
                free = b
    return [(k, a, b, _pattern(text, k, a, b, strict)) for k, a, b, strict in found]


def _pattern(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """(kind, votes of the labelers: 0 none, 1 for, 2 against; then size class, separators, word next to it)."""
    span, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits = "".join(_DIGIT.findall(span))
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    proof = 1 if strict else 2
    if kind == "email":
        known = 1 if span.rsplit(".", 1)[-1].strip(" )]").lower() in ENDINGS else 2
        shape = 1 if re.match(r"[A-Za-z0-9]", span) else 2
        proof = 1 if strict else 0  # the strict pattern knows no spelled-out marks
    elif kind == "ip":
        known = 2 if groups[0] in ("0", "00", "000") or any(len(g.lstrip("0")) > 3 or int(g) > 255 for g in groups) else 1
        shape = 1 if len(groups) == 4 and not any(len(g) > 1 and g[0] == "0" for g in groups) else 2
    elif kind == "card":
        known = 1 if digits.startswith(CARD_PREFIXES) else 2
        shape = 1 if luhn(digits) and (len(groups) == 1 or [len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5])) else 2
    elif kind == "phone":
        known = 0 if span[0] != "+" else 1 if digits.startswith(CALLING_CODES) else 2
        shape = 2 if len(groups) > 6 or len(digits) < 8 or len(groups) == 1 and span[0] != "+" else 1
        proof = 1 if strict else 2 if span[0] == "+" else 0  # without a plus the strict pattern says nothing
    else:
        whole = _HEX.fullmatch(span) is not None
        proof = 1 if whole and len(span) in KEY_LENGTHS else 0
        known = 1 if span.startswith(KEY_PREFIXES) else 0
        switches = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:], strict=False))
        shape = 1 if len(set(span)) >= 8 and 4 * switches >= len(span) else 2
    context = 1 if _FOR[kind].search(before) else 0
    against = 2 if _AGAINST.search(before) or before[-1:] in ("$", "€", "£", "#") or text[b : b + 1] in ("%", "€") else 0
    glued = before[-1:].isalnum() or text[b : b + 1].isalnum()
    return KINDS.index(kind), proof, known, context, against, shape, min(3, len(digits) // 5), min(2, len(groups) // 2), int(glued)


def vote_counts(docs: DataFrame) -> DataFrame:
    """pattern and n, over the candidates of all documents."""

    def make():
        def each(batch):
            total: dict[str, int] = {}
            for text in texts(batch):
                for *_, pattern in candidates(text, base_spans(text)):
                    key = ",".join(map(str, pattern))
                    total[key] = total.get(key, 0) + 1
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["pattern", "n"])

        return each

    return map_rows(docs, {"text": "text"}, make, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


#: Votes (none, for, against) that each labeler is credited with, by truth: no, yes.
PRIOR = np.array([[2.0, 0.5, 2.0], [2.0, 2.0, 0.5]])


def majority(votes: np.ndarray) -> np.ndarray:
    """Where expectation-maximisation starts: a logistic of the votes for less those against."""
    return 1 / (1 + np.exp(-1.5 * ((votes == 1).sum(1) - (votes == 2).sum(1) - 0.5)))


class SpanModel:
    """Reliabilities of the labelers by expectation-maximisation, and the logistic classifier fitted to the outcome."""

    def __init__(self, counts: list[tuple[tuple[int, ...], int]]):
        self.weights = None
        if not counts:
            return
        counts = sorted(counts)
        patterns, n = np.asarray([p for p, _ in counts]), np.asarray([c for _, c in counts], float)
        votes, kind = patterns[:, 1 : 1 + LABELERS], patterns[:, 0]
        truth = majority(votes)
        self.accuracy = np.zeros((len(KINDS), LABELERS, 2, 3))
        for _ in range(STEPS):
            new = np.zeros(len(n))
            for k in range(len(KINDS)):
                here = kind == k
                if not here.any():
                    continue
                weight = np.stack([n[here] * (1 - truth[here]), n[here] * truth[here]])
                prior = (weight.sum(1) + 1) / (weight.sum() + 2)
                score = np.tile(np.log(prior)[:, None], here.sum())
                for j in range(LABELERS):
                    # PRIOR votes of a labeler that is right more often than wrong, so that truth keeps its name
                    table_ = np.stack([[weight[y][votes[here, j] == v].sum() for v in range(3)] for y in (0, 1)]) + PRIOR
                    table_ /= table_.sum(1, keepdims=True)
                    self.accuracy[k, j] = table_
                    score += np.log(table_[:, votes[here, j]])
                new[here] = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
            moved = np.abs(new - truth).max()
            truth = new
            if moved < 1e-6:
                break
        self.truth = dict(zip(map(tuple, patterns.tolist()), truth.tolist(), strict=True))
        x = np.stack([self.features(tuple(p)) for p in patterns])
        w, scale = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
            step = np.linalg.solve(hessian, x.T @ (scale * (truth - p)) - 1e-4 * w)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    @staticmethod
    def features(pattern: tuple[int, ...]) -> np.ndarray:
        kind, *rest = pattern
        out = np.zeros((len(KINDS), 1 + 3 * LABELERS + 4 + 3 + 2))
        row = out[kind]
        row[0] = 1
        for j, v in enumerate(rest[:LABELERS]):
            row[1 + 3 * j + v] = 1
        a, b, c = rest[LABELERS:]
        row[1 + 3 * LABELERS + a] = row[5 + 3 * LABELERS + b] = row[8 + 3 * LABELERS + c] = 1
        return out.ravel()

    def probability(self, pattern: tuple[int, ...]) -> float:
        return 0.0 if self.weights is None else float(1 / (1 + np.exp(-np.clip(self.features(pattern) @ self.weights, -30, 30))))


def train(docs: DataFrame) -> SpanModel:
    """The model of all candidates of docs; the driver gets the pattern counts only."""
    return SpanModel([(tuple(map(int, r["pattern"].split(","))), r["n"]) for r in vote_counts(docs).collect()])


def _shown(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SpanModel, certain: float = CERTAIN) -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of each document."""

    def make():
        known: dict[tuple[int, ...], bool] = {}

        def each(batch):
            rows = []
            for text in texts(batch):
                base = base_spans(text)
                spans = list(base)
                if model.weights is not None:
                    for k, a, b, pattern in candidates(text, base)[len(base) :]:
                        if pattern not in known:
                            known[pattern] = model.probability(pattern) >= certain
                        if known[pattern]:
                            spans.append((k, a, b))
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                number = [sum(s[0] == k for s in base) for k in BASE]
                rows.append((*number, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
