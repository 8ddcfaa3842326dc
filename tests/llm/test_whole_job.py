"""What the operators once left out, against brute force."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from attestor.llm import op02_near, op05_chunks, op10_pieces
from attestor.operators import metrics

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_stage_links_from_080(spark):
    """Pairs of one edit each, of similarities from 0.7 to 0.9."""
    rnd = random.Random(8)
    rows, expected = [], set()
    for i, n in enumerate(range(32, 108, 2)):
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        edited = [*w[: n // 2], f"edit{i}", *w[n // 2 + 1 :]]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited))]
        a, b = (shingles(t) for _, t in rows[-2:])
        expected |= {2 * i} if 100 * len(a & b) >= 80 * len(a | b) else {2 * i, 2 * i + 1}
    assert {r["doc_id"] for r in op02_near.keep_one(frame(spark, rows)).collect()} == expected
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()} == expected
    assert (1 - 0.8**op02_near.ROWS) ** op02_near.WIDE_BANDS < 1e-6


def without_repeats(rows):
    """Brute force: lines of windows of two lines that have occurred before, and of chunks that have."""
    places, seen, out = {}, set(), {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for k, (a, b) in enumerate(zip(filled, filled[1:], strict=False)):
            first = places.setdefault(tuple(lines[a : b + 1]), (d, k))
            if first[0] != d or k > first[1] + 1:
                gone |= set(range(a, b + 1))
        at = 0
        for chunk, n in op05_chunks.chunks_of(t):
            body = "\n".join(chunk)
            if n >= 2 and body in seen:
                gone |= set(range(at, at + len(chunk)))
            seen |= {body} if n >= 2 else set()
            at += len(chunk)
        out[d] = (len(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


def test_short_passages_go(spark):
    """Passages of two to six lines inside otherwise different documents, blank lines, and a line that repeats itself."""
    rnd = random.Random(9)
    passages = [[f"passage {p} line {i}" for i in range(rnd.randint(2, 6))] for p in range(12)]
    rows = []
    for d in range(60):
        own = [f"own line {d} {i}" for i in range(rnd.randint(2, 8))]
        if rnd.random() < 0.3:
            own.insert(rnd.randint(0, len(own)), " " * rnd.randint(0, 2))
        at = rnd.randint(0, len(own))
        own[at:at] = rnd.choice(passages)
        rows.append((d, "\n".join(own)))
    rows += [(90, "\n".join(["again"] * 7)), (91, "x\n\ny\nz"), (92, "x\ny\nz"), (93, "")]
    expected = without_repeats(rows)
    got = {r["doc_id"]: r for r in op05_chunks.counts(frame(spark, rows), fine=True).collect()}
    assert {d: (r["n_removed_lines"], r["kept_sha256"]) for d, r in got.items()} == {d: (n, hashlib.sha256(t.encode()).hexdigest()) for d, (n, t) in expected.items()}
    assert got[90]["n_removed_lines"] == 5 and got[92]["n_removed_lines"] == 2
    seen = set()
    for d, t in rows[:60]:  # of a passage that has occurred before, nothing is left
        for i, p in enumerate(passages):
            if "\n".join(p) in t:
                assert i not in seen or not set(p) & set(expected[d][1].split("\n"))
                seen.add(i)
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect()}
    assert stage == {d: t for d, (n, t) in expected.items() if t.strip() or not n}


def test_decoded_digest_is_of_the_ids():
    """A fault in the ids shows in the digest of the decoded text."""
    own = op10_pieces.PieceCodec(op10_pieces.default_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = "some words\nof a  text é 你"
    ids = own.library.encode(text)
    assert own.digests([text, ""]) == [(len(ids), sha(",".join(map(str, ids))), sha(own.library.decode(ids))), (0, sha(""), sha(""))]
    own.new[" words"] = own.new[" some"]
    assert own.digests([text])[0][2] == sha("some some\nof a  text é 你")


def test_all_short_queries_are_compared(spark):
    """More than 10,000 queries of fewer than five words."""
    n = 10_050
    docs = spark.createDataFrame([(1, "".join(f"[{i}]" for i in range(n))), (2, "nothing"), (3, None)], "doc_id long, text string")
    queries = spark.range(n).selectExpr("id as query_id", "concat('[', id, ']') as text")
    assert {tuple(r) for r in metrics.containing(docs, queries).collect()} == {(i, 1) for i in range(n)}
