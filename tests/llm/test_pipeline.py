"""The corpus pipeline against a brute-force version of its stages on whole small tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import duckdb
import pytest
import sentencepiece
from attestor.llm import op03_lines, op05_chunks, op10_pieces, registry
from attestor.llm.common import table

SF = "/root/testdata/sf0.001"


def without_repeats(rows):
    """Brute force: lines of windows of two lines that have occurred before, and of chunks that have."""
    places, seen, out = {}, set(), {}
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for k, (a, b) in enumerate(zip(filled, filled[1:], strict=False)):
            first = places.setdefault(tuple(lines[a : b + 1]), (d, k))
            if first[0] != d or k > first[1] + 1:
                gone |= set(range(a, b + 1))
        at = 0
        for chunk, n in op05_chunks.chunks_of(t or ""):
            body = "\n".join(chunk)
            if n >= 2 and body in seen:
                gone |= set(range(at, at + len(chunk)))
            seen |= {body} if n >= 2 else set()
            at += len(chunk)
        out[d] = (len(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = op03_lines.train(spark, docs, labels)
    rows = {}
    for r in docs.collect():
        n, _, _, _, repeats = op03_lines.base_counts(r["text"])
        if n >= 50 and 100 * repeats <= 50 * n:
            lines, sizes = op03_lines.line_features(r["text"])
            if sum(s for s, y in zip(sizes, field.viterbi(lines), strict=True) if y) >= field.share * n:
                rows[r["doc_id"]] = r["text"]
    assert 0 < len(rows) < docs.count()

    cut = {d: t for d, (gone, t) in without_repeats(list(rows.items())).items() if t.strip() or not gone}

    sets = {d: shingles(t) for d, t in cut.items()}
    group = {d: d for d in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    single = {d: t for d, t in cut.items() if top(d) == d}

    items = [shingles(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {d: t for d, t in single.items() if not any(q and 100 * len(q & sets[d]) >= 80 * len(q) for q in items)}

    library = sentencepiece.SentencePieceProcessor(model_file=op10_pieces.default_model())
    expected = {}
    for d, t in clean.items():
        own = library.encode(t)
        expected[d] = (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(library.decode(own).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()} == expected
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_stages_return_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).schema.names == docs.schema.names, name


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    result = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(result.fetchall())
