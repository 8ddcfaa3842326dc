"""Faults that the operators once had, and methods against brute force."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from attestor.llm import op01_repeats, op02_near, op03_lines, op06_licences, op07_private, op08_tokens, op10_pieces
from attestor.llm.common import fresh_path, shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


# --- words and shingles ------------------------------------------------------


def test_shingles_of_few_words():
    """0 to 7 words in a batch of one row, and of several."""
    for n in range(8):
        hashes, bounds = shingle_hashes(*word_hashes(pa.RecordBatch.from_pydict({"text": [" ".join("abcdefg"[:n])]})))
        assert len(hashes) == (max(1, n - 4) if n else 0) and bounds.tolist() == [0, len(hashes)]
    words, bounds = word_hashes(pa.RecordBatch.from_pydict({"text": [None, "\tA b\x0bC ", "", "c\x1cd é", "  "]}).slice(1))
    assert np.diff(bounds).tolist() == [3, 0, 2, 0]
    one, _ = word_hashes(pa.RecordBatch.from_pydict({"text": ["a B c"]}))
    assert words[:3].tolist() == one.tolist() and len(set(words.tolist())) == 5


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t[:n]


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement are alike to every polynomial hash modulo 2**64."""
    a = thue_morse(2048)
    b = a.translate({97: 98, 98: 97})
    rows = [(1, a), (2, b), (3, "one two three")]
    assert {r["doc_id"]: r["component_id"] for r in op02_near.classes(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3}
    assert op02_near.set_id(np.asarray([3], np.uint64)) != op02_near.set_id(np.asarray([4], np.uint64))


def test_places_and_marks_of_any_slices(spark):
    """Repeats don't depend on how rows are dealt over slices and partitions."""
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[(s := rnd.randint(0, 2000)) : s + rnd.randint(90, 900)]) for i in range(60)]
    want = None
    for parts in (1, 3, 17):
        docs = frame(spark, rnd.sample(rows, len(rows))).repartition(parts)
        got = sorted(tuple(r) for r in op01_repeats.remove(docs).collect())
        want = want or got
        assert got == want


# --- 3 -----------------------------------------------------------------------


def test_field_is_fitted_to_line_labels():
    """The likelihood's slope is nil where the fit ends, by enumeration of all label sequences."""
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(0, op03_lines.N_FEATURES, (k, op03_lines.N_ACTIVE)).tolist() for k in (1, 2, 3, 3, 2, 1)]
    lines = [[0], [0, 1], [0, 1, 1], [1, 0, 0], [1, 1], [1]]
    labels = [0, 0, 1, 0, 1, 1]
    field = op03_lines.LineField.fit(docs, labels, lines, steps=3000, rate=0.05, l2=0.05)
    weight = [0.5 / labels.count(y) for y in labels]

    def loss(step):
        total = -0.5 * 0.05 * float((step**2).sum())
        for d, own, w in zip(docs, lines, weight, strict=True):
            e = field.emit[np.asarray(d)].sum(1)
            score = lambda ys: sum(e[i, y] for i, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: E731, B023
            every = [score([k >> i & 1 for i in range(len(d))]) for k in range(1 << len(d))]
            total += w / len(d) * (score(own) - math.log(sum(map(math.exp, every))))
        return total

    for a in (0, 1):
        for b in (0, 1):
            up, down = field.step.copy(), field.step.copy()
            up[a, b] += 1e-4
            down[a, b] -= 1e-4
            assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(0, abs=1e-3)


def test_labels_change_within_documents():
    rnd = random.Random(5)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(15)).capitalize() + "."
    junk = lambda: "menu | home | about | login | ### | $$$"
    texts = ["\n".join(prose() for _ in range(5)) for _ in range(30)] + ["\n".join([prose()] + [junk() for _ in range(6)] + [prose()]) for _ in range(30)]
    documents, sizes = zip(*map(op03_lines.line_features, texts), strict=True)
    field = op03_lines.LineField.learn(list(documents), list(sizes), [1] * 30 + [0] * 30)
    assert field.viterbi(op03_lines.line_features("\n".join([prose(), junk(), junk(), prose(), prose()]))[0]) == [1, 0, 0, 1, 1]


# --- 6 -----------------------------------------------------------------------


def plain_align(a, b, i=0, j=0):
    """Patience alignment by its definition, the longest increasing subsequence by trying all."""
    out = []
    while a and b and a[0] == b[0]:
        out.append((i, j))
        a, b, i, j = a[1:], b[1:], i + 1, j + 1
    tail = []
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
        tail.append((i + len(a), j + len(b)))
    both = [(x, b.index(w)) for x, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    best = []
    for k in range(1 << len(both)):
        some = [p for n, p in enumerate(both) if k >> n & 1]
        if len(some) > len(best) and all(p[1] < q[1] for p, q in zip(some, some[1:], strict=False)):
            best = some
    if best:
        for (x, y), (u, v) in zip([(-1, -1), *best], [*best, (len(a), len(b))], strict=True):
            out += plain_align(a[x + 1 : u], b[y + 1 : v], i + x + 1, j + y + 1)
        out += [(i + x, j + y) for x, y in best]
    return sorted(out + tail)


def test_alignment_by_definition():
    rnd = random.Random(6)
    for _ in range(400):
        a, b = ([rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        got = op06_licences.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        # of several longest subsequences either may be taken, so only unambiguous cases are equal pair by pair
        assert len(got) >= 1 if plain_align(a, b) else not got
    a, b = list("abcdef"), list("xabydefz")
    assert op06_licences.align(a, b) == plain_align(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6)]


def test_many_licences_in_a_long_text():
    scanner = op06_licences.Scanner(op06_licences.TEMPLATES)
    began = time.time()
    hits = scanner.hits("Released under the MIT License. Some other words stand here. " * 15_000)
    assert len(hits) == 15_000 and time.time() - began < 60


# --- 7 -----------------------------------------------------------------------


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in op07_private.EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in op07_private.IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in op07_private.CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in op07_private.PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(7)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.2@-+ ()9é_%") for _ in range(rnd.randint(0, 40)))
        assert op07_private.base_spans(t) == plain_base(t), t


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "+1" * 200_000, "a1" * 200_000):
        op07_private.candidates(t, op07_private.base_spans(t))
    assert time.time() - began < 30


def plain_em(counts, steps):
    """Expectation-maximisation of one kind in plain loops."""
    start = lambda p: 1 / (1 + math.exp(-1.5 * (sum(v == 1 for v in p[1:6]) - sum(v == 2 for v in p[1:6]) - 0.5)))
    truth = {p: start(p) for p in counts}
    for _ in range(steps):
        new = {}
        yes, no = sum(n * truth[p] for p, n in counts.items()) + 1, sum(n * (1 - truth[p]) for p, n in counts.items()) + 1
        for p in counts:
            ratio = math.log(yes / no)
            for j in range(5):
                table = [[op07_private.PRIOR[y][v] + sum(n * (truth[q] if y else 1 - truth[q]) for q, n in counts.items() if q[1 + j] == v) for v in range(3)] for y in (0, 1)]
                ratio += math.log(table[1][p[1 + j]] / sum(table[1])) - math.log(table[0][p[1 + j]] / sum(table[0]))
            new[p] = 1 / (1 + math.exp(-ratio))
        done = max(abs(new[p] - truth[p]) for p in counts) < 1e-6
        truth = new
        if done:
            break
    return truth


def test_reliabilities_by_plain_loops():
    rnd = random.Random(8)
    counts = {}
    for _ in range(40):
        p = (1, *(rnd.randint(0, 2) for _ in range(5)), rnd.randint(0, 3), rnd.randint(0, 2), rnd.randint(0, 1))
        counts[p] = rnd.randint(1, 50)
    got = op07_private.SpanModel(list(counts.items())).truth
    for p, x in plain_em(counts, op07_private.STEPS).items():
        assert got[p] == pytest.approx(x, abs=1e-4)


def test_planted_spans_beyond_the_base(spark):
    """Keys, spelled-out addresses and phone numbers without a plus, among look-alikes; shares caught and wrongly taken."""
    rnd = random.Random(9)
    filler = lambda: " ".join(rnd.choice(["sun", "hill", "river", "stone", "cloud"]) for _ in range(8))
    hexed = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows, planted, decoys = [], set(), set()
    for i in range(300):
        kind = i % 5
        span = [f'{hexed(40)}', f"user{i} [at] mail{i % 7} [dot] com", f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", f"{rnd.randint(100, 999)}.{rnd.randint(0, 9)}", hexed(40)][kind]
        lead = ['token = "', "contact ", "phone ", "total ", "commit "][kind]
        head = filler() + " " + lead
        rows.append((i, head + span + ('" ' if kind == 0 else " ") + filler()))
        (planted if kind < 3 else decoys).add((i, len(head), len(head) + len(span)))
    docs = frame(spark, rows)
    model = op07_private.train(docs)
    found = {(r["doc_id"], int(a), int(b)) for r in op07_private.find(docs, model).collect() for _, a, b in (x.split(":") for x in r["spans"].split(",") if x)}
    caught, wrong = len(found & planted) / len(planted), len(found & decoys) / len(decoys)
    print(f"caught {caught:.2f}, look-alikes taken {wrong:.2f}")
    assert caught >= 0.9 and wrong <= 0.1


# --- 8 -----------------------------------------------------------------------


def test_two_thousand_files_near_their_share(spark):
    import public_tokenizers
    from pyarrow import fs

    rnd = random.Random(10)
    rows = [(i // 3 if i < 3000 else 5_000_000, " ".join(rnd.choice(["sun", "hill", "river"]) for _ in range(40))) for i in range(6000)]
    folder = fresh_path(spark, "tokens")
    encoded = op08_tokens.encode(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"))
    ranks = op08_tokens.ranking(encoded)
    size = sum(len(t) for _, t in rows) // 2000
    manifest = op08_tokens.write_files(encoded, ranks, folder, size, most_tasks=7)
    listed = manifest.collect()
    assert 1500 < len(listed) < 2200 and max(r["n_docs"] for r in listed) <= 4
    assert len({r["part"] for r in listed}) > 5  # half of the rows share a doc_id, and are dealt all the same
    got = op08_tokens.read_files(manifest, ranks, folder).orderBy("start").collect()
    assert len(got) == 6000 and [r["doc_id"] for r in got] == sorted(d for d, _ in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert len(fs.FileSystem.from_uri(folder)[0].get_file_info(fs.FileSelector(folder.removeprefix("file://")))) == len(listed)


def test_words_by_parts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rnd = Tokenizer.from_file(path), op08_tokens.WordEncoder(path), random.Random(11)
    alphabet = "abcXYZéÉÀöñßØøÞ÷×ªµ'\"!?.,_-<|>`~@[]{}()  \n\t0129ſßıİΣςȩ́你ﬁ \x00'st'll"
    for k in range(2000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) + (" <|endoftext|> x<|startoftext|>y" if k % 50 == 0 else "")
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


# --- 10 ----------------------------------------------------------------------


def test_matrix_agenda_is_the_heap():
    own, rnd = op10_pieces.PieceCodec(op10_pieces.default_model()), random.Random(12)
    alphabet = "abcdeXYZéßØ'!?.,-<>0129你ﬁ\x00thereingtion"
    segments = [" " * rnd.randint(0, 2) + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 90))) for _ in range(1500)] + [" " + "a" * n for n in range(1, 70)] + ["\n", " "]
    assert own.encode_segments(segments) == [own.encode_segment(s) for s in segments]
    assert own.encode_segments([]) == []


def test_a_fault_in_decoding_shows():
    own = op10_pieces.PieceCodec(op10_pieces.default_model())
    own.bytes_of[own.library.encode("some")[0]] = b" other"
    with pytest.raises(ValueError, match="decoded otherwise"):
        own.digests(["some words"])
