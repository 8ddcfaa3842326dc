"""Each operator against brute force on small fixtures, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from attestor.llm import op01_repeats, op02_near, op03_lines, op04_perplexity, op05_chunks, op06_licences, op07_private, op08_tokens, op09_contain, op10_pieces
from attestor.llm.common import fresh_path
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "and", "ering", "éa", "Straße", "x" * 30, "licensed", "42", "##", "a.b"]
    texts = []
    for i in range(90):
        t = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 90)))
        if rnd.random() < 0.4:
            t = t.replace(" of ", "\n")
        if i % 5 == 1:
            base = rnd.choice(texts)
            t = t[:60] + base[rnd.randint(0, len(base)) :] + t[60:]
        if i % 9 == 2:
            t = rnd.choice(texts)
        if i % 9 == 4:
            w = rnd.choice(texts).split(" ")
            w[rnd.randrange(len(w))] = f"edit{i}"
            t = " ".join(w)
        if i % 17 == 3:
            t = "ab" * rnd.randint(20, 900)
        texts.append(t)
    return [(3 * i, t) for i, t in enumerate(texts)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "some words here that repeat " * 9), (4, "Ä one"), (4, "Ä one"), (5, "word " * 30_000), (6, "word " * 30_000), (7, "nul\0byte 🙂   end"), (8, "a@b.co +1 (222) 333-4444 4111 1111 1111 1111 10.0.0.256 1.2.3.4")]


# --- 1 -----------------------------------------------------------------------


def removed(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(k)
        gone = np.cumsum(cover)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_run_index_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(20):
        base = bytes(rnd.choice(b"ab\0") for _ in range(400))
        pieces = []
        for _ in range(rnd.randint(1, 8)):
            a = rnd.randint(0, 300)
            piece = bytearray(base[a : a + rnd.randint(100, 160)])
            if rnd.random() < 0.5:
                piece[rnd.randrange(len(piece))] = 99
            pieces.append(bytes(piece))
        for least in (3, 20, 100):
            seen, expected = set(), []
            for p in pieces:
                for i in range(len(p) + 1):
                    k = p[i : i + least]
                    expected.append(len(k) == least and k in seen)
                    if len(k) == least:
                        seen.add(k)
            index = op01_repeats.RunIndex(pieces)
            assert index.repeats(least).tolist() == expected
            assert index.runs <= len(expected)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, corpus, hot):
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in op01_repeats.remove(frame(spark, corpus[::-1]), hot).collect()}
    assert got == removed(corpus)


def test_repeats_odd(spark):
    got = op01_repeats.remove(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 0][2] == 0 and by[6, 150_000][2] == 150_000 and by[5, 150_000][2] == 150_000 - 5
    assert op01_repeats.remove(frame(spark, [])).count() == 0


# --- 2 -----------------------------------------------------------------------


def near(rows, link=85):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= link * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def test_near_classes(spark, corpus):
    got = {r[0]: tuple(r[1:]) for r in op02_near.classes(frame(spark, corpus)).collect()}
    assert got == near(corpus)


def test_near_classes_of_edits(spark):
    """Many edited copies, whose links form chains."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"e{i}-{k}" if rnd.random() < 0.5 else f"e{rnd.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    assert {r[0]: tuple(r[1:]) for r in op02_near.classes(frame(spark, rows)).collect()} == near(rows)


def test_near_odd(spark):
    got = op02_near.classes(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["kept"]
    assert op02_near.classes(frame(spark, [])).count() == 0
    assert op02_near.keep_one(frame(spark, ODD).withColumn("_gone", F.lit(1))).columns[-1] == "_gone"


# --- 3 -----------------------------------------------------------------------


def test_base_counts():
    n, chars, symbols, duplicates, repeats = op03_lines.base_counts("a b c d\na b c\n \n \na b c # <")
    assert (n, chars, symbols, duplicates, repeats) == (12, 12, 2, 0, 9)
    assert op03_lines.base_counts("x y\nx y\n\n")[3] == 1
    assert op03_lines.base_counts("") == (0, 0, 0, 0, 0)


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(0)
    field = op03_lines.LineField(rnd.normal(size=(op03_lines.N_FEATURES, 2)), rnd.normal(size=(2, 2)))
    lines = rnd.integers(0, op03_lines.N_FEATURES, (7, op03_lines.N_ACTIVE)).tolist()

    def score(path):
        return sum(field.emit[f, y] for fs, y in zip(lines, path, strict=True) for f in fs) + sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False))

    paths = [[k >> i & 1 for i in range(7)] for k in range(128)]
    assert score(field.viterbi(lines)) == pytest.approx(max(map(score, paths)))


def test_line_labels_separate(spark):
    rnd = random.Random(7)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(15)).capitalize() + "."
    good = [(i, "\n".join(prose() for _ in range(6))) for i in range(40)]
    bad = [(100 + i, "\n".join("menu | home | about | login | ### | $$$" for _ in range(12)) + f" {i}") for i in range(40)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in bad[::2]], "doc_id long, quality int, toxic int")
    field = op03_lines.train(spark, docs, labels)
    got = {r["doc_id"]: r["kept"] for r in op03_lines.label_lines(docs, field).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)
    assert op03_lines.keep_good(docs, field).columns == docs.columns
    assert op03_lines.label_lines(frame(spark, ODD), op03_lines.LineField.zero()).count() == len(ODD)
    assert op03_lines.label_lines(frame(spark, []), field).count() == 0


# --- 4 -----------------------------------------------------------------------


def kneser_ney(texts, order):
    """Brute force in dictionaries: p(unit, context) of interpolated modified Kneser-Ney, contexts as tuples."""
    start, end = op04_perplexity._START, op04_perplexity._END
    raw = [Counter() for _ in range(order + 1)]
    for t in texts:
        u = [start] * (order - 1) + list(map(ord, t)) + [end]
        for i in range(order - 1, len(u)):
            raw[order][tuple(u[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g, c in raw[k + 1].items():
            raw[k][g[1:]] += c if g[1] == start else 1
    units = len(raw[1]) + 1
    discount = {}
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, sum(c == i for c in raw[k].values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]

    def p(g):
        k = len(g)
        if not k:
            return 1 / units
        around = {h: c for h, c in raw[k].items() if h[:-1] == g[:-1]}
        if not around:
            return p(g[1:])
        total = sum(around.values())
        d = lambda c: discount[k][min(c, 3) - 1]
        own = (around[g] - d(around[g])) / total if g in around else 0
        return own + sum(map(d, around.values())) / total * p(g[1:])

    return p, units


def test_kneser_ney_is_that_of_dictionaries(spark):
    """Sums to one, and equals brute force, with marks of its own, characters beyond the basic plane, and digits."""
    trained, asked = ["abracadabra abba", "a\x01b\x02c 🙂🙃 𠀀𠀁 1234", "abba", "", "abba"], ["abrabba 🙃🙂 2143", "zz", "abba"]
    order = op04_perplexity.ORDER
    hi, lo, which, _ = op04_perplexity.grams_of([t for t in trained if t])
    counts = spark.createDataFrame(list(zip(hi.tolist(), lo.tolist(), np.bincount(which).tolist(), strict=True)), "hi long, lo long, c long")
    orders = op04_perplexity.model(counts)
    p, units = kneser_ney([t for t in trained if t], order)
    hi, lo, which, lengths = op04_perplexity.grams_of(asked)
    got = {(r["hi"], r["lo"]): r["logp"] for r in op04_perplexity.answers(spark.createDataFrame(list(zip(hi.tolist(), lo.tolist(), strict=True)), "hi long, lo long"), orders).collect()}
    at = 0
    for t, n in zip(asked, lengths.tolist(), strict=True):
        u = [op04_perplexity._START] * (order - 1) + list(map(ord, t)) + [op04_perplexity._END]
        for i in range(n):
            j = which[at + i]
            assert np.exp(got[int(hi[j]), int(lo[j])]) == pytest.approx(p(tuple(u[i : i + order])), rel=1e-9)
        at += n
    seen = set(map(ord, "".join(trained))) | {op04_perplexity._END}
    for context in ("abra", "zzzz", "🙂🙃 𠀀"):
        assert sum(p((*map(ord, context), x)) for x in [*seen, ord("q")]) == pytest.approx(1)
    assert units == len(seen) + 1


def test_grams_of_large_alphabets():
    rnd = random.Random(8)
    many = ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(9000)), "ab"]
    hi, lo, which, lengths = op04_perplexity.grams_of(many)
    u, ends = op04_perplexity.units_of(many)
    assert lengths.tolist() == [9001, 3] and len(which) == 9004 and ends[-1] == len(u)
    assert [int(lo[j]) & (1 << 21) - 1 for j in which[9001:]] == [97, 98, op04_perplexity._END]


def test_perplexity_separates(spark):
    rnd = random.Random(3)
    prose = lambda: " ".join(rnd.choice(["the", "sun", "rises", "over", "hills", "and", "sea"]) for _ in range(60))
    noise = lambda: "".join(rnd.choice("#$%&*|<>QZXJ0") for _ in range(300))
    good, bad = [(i, prose()) for i in range(40)], [(100 + i, noise()) for i in range(10)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(100, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in op04_perplexity.judge(docs, labels).collect()}
    assert sum(got[i]["kept"] for i, _ in good) >= 38 and not any(got[i]["kept"] for i, _ in bad)
    odd = op04_perplexity.judge(frame(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and not any(r["kept"] for r in odd if not r["n_units"]) and any(r["kept"] for r in odd)
    assert op04_perplexity.judge(frame(spark, []), labels).count() == 0


# --- 5 -----------------------------------------------------------------------


def chunked(rows):
    """Brute force: chunks by their bytes, the first stays."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        rest = []
        for lines, filled in op05_chunks.chunks_of(t):
            body = "\n".join(lines)
            if filled >= 2 and body in seen:
                continue
            if filled >= 2:
                seen.add(body)
            rest.append(body)
        out[d] = "\n".join(rest)
    return out


def test_chunks(spark):
    rnd = random.Random(4)
    lines = [f"line number {i}" for i in range(12)]
    shared = [f"shared {i}" for i in range(10)]
    rows = []
    for i in range(40):
        own = [rnd.choice(lines) + str(rnd.randint(0, 5)) for _ in range(rnd.randint(1, 20))]
        if i % 3 == 0:
            at = rnd.randint(0, len(own))
            own[at:at] = shared
        rows.append((i, "\n".join(own)))
    expected = chunked(rows)
    got = {r["doc_id"]: r for r in op05_chunks.counts(frame(spark, rows)).collect()}
    assert {d: r["kept_sha256"] for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in expected.items()}
    assert sum(r["n_removed_chunks"] for r in got.values()) > 5
    assert op05_chunks.dedup(frame(spark, rows).withColumn("_cut", F.lit(1)).withColumn("cut", F.lit(2))).columns[-2:] == ["_cut", "cut"]
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in op05_chunks.dedup(frame(spark, rows)).collect()}
    assert kept == {d: (t, len(t)) for d, t in expected.items() if t.strip()}


def test_chunk_ends_resist_shifts():
    lines = [f"text of line {i * 7919 % 1000}" for i in range(300)]
    a = {"\n".join(c) for c, _ in op05_chunks.chunks_of("\n".join(lines))}
    b = {"\n".join(c) for c, _ in op05_chunks.chunks_of("\n".join(["new first line", *lines]))}
    assert len(a & b) > 0.9 * len(a)


def test_chunks_odd(spark):
    assert op05_chunks.counts(frame(spark, ODD)).count() == len(ODD)
    assert op05_chunks.dedup(frame(spark, ODD)).count() == len(ODD)
    assert op05_chunks.dedup(frame(spark, [])).count() == 0


# --- 6 -----------------------------------------------------------------------


def test_longest_increasing_and_align():
    assert op06_licences.longest_increasing([3, 1, 2, 5, 4]) == [1, 2, 4]
    a, b = "the quick brown fox jumps over the lazy dog".split(), "so the quick red fox then jumps over one lazy dog".split()
    pairs = op06_licences.align(a, b)
    assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == "the quick fox jumps over lazy dog".split()
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)


def test_licences(spark):
    notice = op06_licences.TEMPLATES["mit-notice"]
    cut = " ".join(w for i, w in enumerate(notice.split()) if i % 12)  # every twelfth word missing
    filler = "words of no licence " * 50
    rows = [(1, filler + "\n" + cut + "\n" + filler), (2, filler), (3, "Licensed under CC BY-NC 4.0."), (4, "All rights reserved. " + filler + " Released under the MIT License. " + filler + " Released under the MIT license"), (5, None)]
    got = {r["doc_id"]: r for r in op06_licences.scan(frame(spark, rows)).collect()}
    assert got[1]["licence"] == "mit-notice" and 0.85 < got[1]["coverage"] < 1
    assert got[2]["n_hits"] == 0 and got[2]["licence"] is None and got[5]["spans"] == ""
    assert got[3]["licence"] == "cc-by-nc-4.0-line" and got[3]["coverage"] == 1
    assert got[4]["n_hits"] == 3
    name, a, b = got[3]["spans"].split(":")
    assert rows[2][1][int(a) : int(b)] == "Licensed under CC BY-NC 4.0"
    assert op06_licences.scan(frame(spark, ODD)).count() == len(ODD) and op06_licences.scan(frame(spark, [])).count() == 0


# --- 7 -----------------------------------------------------------------------


def test_base_spans():
    text = "a@b.co, 1.2.3.4 300.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (222) 333-4444 +1"
    shown = [(k, text[a:b]) for k, a, b in op07_private.base_spans(text)]
    assert shown == [("email", "a@b.co"), ("ip", "1.2.3.4"), ("phone", "+1 (222) 333-4444")]  # the digits of 1.1 4111 ... make one long match, which fails


def test_private_spans(spark):
    rows = [(i, f"mail me at user{i}@example.com or call +1 (202) 555-01{i:02d} today") for i in range(30)] + [(50, "plain text, nothing here"), (51, None)]
    docs = frame(spark, rows)
    model = op07_private.train(docs)
    got = {r["doc_id"]: r for r in op07_private.find(docs, model).collect()}
    assert all(got[i]["n_email"] == 1 and got[i]["n_phone"] == 1 for i in range(30))
    assert got[50]["spans"] == "" and got[51]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for i, t in rows[:30]:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in op07_private.base_spans(t))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and base in got[i]["spans"]
    assert op07_private.find(frame(spark, ODD), model).count() == len(ODD) and op07_private.find(frame(spark, []), op07_private.SpanModel([])).count() == 0


# --- 8 -----------------------------------------------------------------------


def test_coding_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1000):
        v = (2.0 ** rnd.uniform(0, 32, n)).astype(np.uint32)
        control, data = op08_tokens.pack(v)
        assert np.array_equal(op08_tokens.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), v)


def test_token_files(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = corpus[::-1] + [(1000, None), (1001, "x  y z\tÉÉ it's <|endoftext|> I'm é ﬁ Σ\n\n"), (1002, "")]
    folder = fresh_path(spark, "tokens")
    encoded = op08_tokens.encode(frame(spark, rows), path)
    ranks = op08_tokens.ranking(encoded)
    manifest = op08_tokens.write_files(encoded, ranks, folder, file_text=5000)
    got = {r["doc_id"]: tuple(r)[1:] for r in op08_tokens.read_files(manifest, ranks, folder).collect()}
    at, expected = 0, {}
    for d, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected[d] = (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == expected and manifest.count() > 3


def test_token_files_odd(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = op08_tokens.encode(frame(spark, ODD), path)
    ranks, folder = op08_tokens.ranking(encoded), fresh_path(spark, "tokens")
    got = op08_tokens.read_files(op08_tokens.write_files(encoded, ranks, folder), ranks, folder).collect()
    assert len(got) == len(ODD) and got[0]["start"] == 0
    assert not len(op08_tokens.ranking(op08_tokens.encode(frame(spark, []), path)))


# --- 9 -----------------------------------------------------------------------


def test_containment(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 60)))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        t = " ".join(word() for _ in range(rnd.randint(0, 3000)))
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1] or ""
            w = w.split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "changed"
            t = t + " " + " ".join(w).upper() + " " + word()
        docs.append((i, t))

    def windows(t, n):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    expected = set()
    for i, t in items:
        n = min(5, len((t or "").split()))
        q = windows(t, n)
        for d, x in docs:
            c = len(q & windows(x, n))
            if q and 100 * c >= 80 * len(q):
                expected.add((d, i, len(q), c))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in op09_contain.search(frame(spark, docs), table).collect()} == expected and len(expected) > 20
    assert {q for _, _, q, _ in expected} > {1} and any(len((dict(items)[i] or "").split()) < 5 for _, i, _, _ in expected)
    kept = op09_contain.drop_contaminated(frame(spark, docs), table)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {e[0] for e in expected}
    assert op09_contain.search(frame(spark, ODD), table).count() == 0 and op09_contain.search(frame(spark, []), table).count() == 0
    assert op09_contain.search(frame(spark, docs), table.limit(0)).count() == 0


# --- 10 ----------------------------------------------------------------------


def test_pieces(spark, corpus):
    import sentencepiece

    path = op10_pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = corpus + [(d and d + 5000, t) for d, t in ODD] + [(2000, "  two  blanks \n\n and▁marks\ttab　wide <s> <0x0A> ﬁ é नमस्ते 你好"), (2001, "\n\n x")]
    got = op10_pieces.encode(frame(spark, rows), path)
    for r, (d, t) in zip(sorted(((x["doc_id"] or 0, x["ids"]) for x in got.collect()), key=str), sorted(((d or 0, library.encode(t or "")) for d, t in rows), key=str), strict=True):
        assert r[0] == d and list(r[1]) == t
    digests = {r["doc_id"]: r for r in op10_pieces.round_trip(frame(spark, rows), path).collect()}
    for d, t in rows:
        if d == 5004 or d is None:
            continue
        ids = library.encode(t or "")
        assert digests[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert op10_pieces.round_trip(frame(spark, []), path).count() == 0
