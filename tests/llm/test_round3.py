"""Whitening, paragraph sketches and fill-in-the-middle against plain versions, with nulls, ties, repeated rows and odd texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from marksheet.llm import fill_middle, paragraph_sketch, whitening

LONG = " ".join(f"word{i % 977}x" for i in range(40_000))
TEXTS = [None, "", " ", "One two.", "a  b\n c \n", "\n\n x", "日本語 😀 é\x00", "keep <P> as it is", "same text here now ok", LONG, "x" * 30_000, "😀 " * 300]
DOC = "doc_id long, text string, h long, pieces string, n int, form string, salt int, task int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "p", 2, "f", 3, 4) for d, t in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma\n", "délta", " ", "ζ", "\t"]
    some = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)]
    return [*enumerate(TEXTS), *some, (3, "One two."), (3, "Another text of the same id"), (3, "One two."), (None, "no id here"), (None, None)]


# ---------------------------------------------------------------- fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark, rows):
    docs = frame(spark, rows)
    got = fill_middle.transform(docs)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()) == Counter(plain_fim(*r) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((d, sha(plain_fim(d, t)[5]), sha(t or "")) for d, t in rows)
    assert Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.digests(got).collect()) == want
    assert fill_middle.transform(docs.limit(0)).count() == 0
    every = fill_middle.transform(docs, fim_rate=100, spm_rate=0)
    assert {r.form for r in every.collect() if r.text and "<P>" not in r.text} == {"psm"}
    assert Counter((r.doc_id, r.restored_sha256) for r in fill_middle.digests(every).collect()) == Counter((d, sha(t or "")) for d, t in rows)


@pytest.mark.parametrize("name", fill_middle.GRAMMARS)
def test_boundaries_give_the_units_of_each_grammar(spark, rows, name):
    grammar = fill_middle.GRAMMARS[name]
    texts = [*{t for _, t in rows if t is not None and len(t) < 5000}, "Who? Me.  Yes... no!x ?", "a.b c. ", ". .", "\n", "ab\n\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", fill_middle.units(df.text, grammar).alias("units")).collect():
        assert r.units == [u for u in re.findall(grammar.unit, r.text) if u], (name, r.text)
        assert "".join(r.units) == r.text


# ---------------------------------------------------------------- paragraph sketches


def plain_paragraphs(text):
    """The paragraphs as bytes, cut one place at a time."""
    data, out, start = text.encode(), [], 0
    padded = bytes(paragraph_sketch.LOOK) + data
    for i in range(len(data)):
        at = i + paragraph_sketch.LOOK
        seen = np.uint64(sum(int(paragraph_sketch._LOOK_BYTE[b][padded[at - b]]) for b in range(paragraph_sketch.LOOK)) % 2**64)
        inside = i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80
        if data[i] == 10 or (paragraph_sketch.mix(np.array([seen]))[0] % np.uint64(paragraph_sketch.EVERY) == 0 and not inside):
            out.append(data[start : i + 1])
            start = i + 1
    return Counter(out + ([data[start:]] if start < len(data) else []))


def plain_likeness(a, b):
    a, b = plain_paragraphs(a), plain_paragraphs(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def test_fingerprints(spark, rows):
    short = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, (h := xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()) - (h >> 63 << 64))
    ordered = sorted(short, key=key)
    want = Counter()
    for (d, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(t, e), 9), round(plain_likeness(t, u), 9)] += 1
    got = paragraph_sketch.fingerprint_documents(frame(spark, short)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert max(r.tries for r in got) > 2
    same = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            same.setdefault(dict(short)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len(set().union(*same.values())) == len(same)
    assert paragraph_sketch.fingerprint_documents(frame(spark, short).limit(0)).count() == 0
    only = paragraph_sketch.fingerprint_documents(frame(spark, [(7, "ab\ncd")])).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in only] == [(7, 1.0, hashlib.sha256(b"ab\nab").hexdigest())]


def test_fingerprints_of_one_id_that_has_most_rows(spark):
    docs = frame(spark, [(5, "the same")] * 200 + [(5, f"other {i}") for i in range(100)] + [(i, f"text {i}") for i in range(10, 60)])
    got = paragraph_sketch.fingerprint_documents(docs).collect()
    assert len(got) == 350 and sum(r.near_next == 1.0 for r in got if r.doc_id == 5 and r.n_chars == 8) >= 199


def test_differences_are_whole_and_exact(spark):
    base = "".join(f"line {i}\n" for i in range(400))
    edit = base.replace("line 7\n", "line seven\n").replace("line 9\n", "") + "line 3\n"
    versions = spark.createDataFrame([(1, base, edit), (2, base, base), (3, "", base), (4, None, None), (5, base, base[::-1])], "doc_id long, old string, new string")
    got = {r.doc_id: r for r in paragraph_sketch.compare_versions(versions).collect()}
    for d, old, new in ((1, base, edit), (2, base, base), (3, "", base), (5, base, base[::-1])):
        a, b = (paragraph_sketch.paragraph_digests([t.encode()]).key.view(np.int64).tolist() for t in (old, new))
        assert sorted(got[d].removed) == sorted(set(a) - set(b)) and sorted(got[d].added) == sorted(set(b) - set(a))
        assert got[d].likeness == pytest.approx(plain_likeness(old, new))
    assert got[2].tries == 1 and got[2].old_fingerprint == got[2].new_fingerprint and got[3].tries > 2 and got[4].likeness == 1.0


def test_peeling_random_differences():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 40, 3000):
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[: len(a) // 2], rng.integers(1, 2**63, n, dtype=np.uint64)))
        one = lambda k: paragraph_sketch.Digests(k, np.array([0, len(k)]))
        d = paragraph_sketch.differences(one(a), one(b))
        assert set(d.old.key) == set(a) - set(b) and set(d.new.key) == set(b) - set(a)


# ---------------------------------------------------------------- whitening

VEC = "vec_id long, embedding array<float>, x long, n int"


def plain_whitening(vectors, k=16):
    xs = [[math.floor(64.0 * c) + 1_000_000 for c in map(float, v)] for v in vectors]
    fit = np.array(sorted(set(map(tuple, xs))), np.float64) - 1_000_000
    n = len(fit)
    sums = [sum(int(v) + 1_000_000 for v in col) for col in fit.T]
    mean = fit.mean(0)
    v = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    white = (np.array(xs, np.float64) - 1_000_000 - mean) @ u / np.sqrt(e)
    return n, deviation, white, e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(24, 24)) * np.linspace(4, 0.3, 24)[:, None]
    good = (rng.normal(size=(700, 24)) @ basis).astype(np.float32)
    good[600:] = good[:100]
    good[650:] = good[0]  # one vector has many copies
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    bad = [(900, None), (901, [float("nan")] * 24), (902, [None] + [1.0] * 23), (903, [float("inf")] * 24), (904, [1.0] * 5), (905, []), (906, [3e38] * 24)]
    df = spark.createDataFrame([(d, v, 5, 6) for d, v in rows + bad], VEC).repartition(7)
    got = whitening.whiten_embeddings(df).collect()
    n, deviation, white, explained = plain_whitening(good)
    assert len(got) == len(good) * 16 and {r.vec_id for r in got} == set(range(700))
    mine = np.zeros((700, 16))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-10
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-8


def test_merging_keeps_everything_in_any_order():
    rng = np.random.default_rng(4)
    y = np.floor(rng.normal(size=(3000, 9)) * 50 * np.linspace(5, 0.1, 9) + 7).astype(np.int64)
    whole = whitening.part_of(y)
    cuts = [0, 1, 2, 40, 900, 2999, 3000]
    parts = [whitening.part_of(y[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for order in (parts, parts[::-1]):
        merged = whitening._merged(order)
        assert merged.n == whole.n and merged.sums == whole.sums
        assert np.allclose(merged.root.T @ merged.root, np.cov(y.T, bias=True) * 3000, rtol=1e-11, atol=1e-6)


def test_whitening_of_few_or_flat_vectors(spark):
    make = lambda rows: spark.createDataFrame([(d, v, 5, 6) for d, v in rows], VEC)
    assert whitening.whiten_embeddings(make([])).count() == 0 and whitening.whiten_embeddings(make([(1, None), (2, [])])).count() == 0
    one = whitening.whiten_embeddings(make([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in one)
    line = whitening.whiten_embeddings(make([(i, [float(i), 1.0, -2.0 * i]) for i in range(40)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)} and abs(line[0].identity_error) < 1e-10
    wide = whitening.Whitening(10**9, [5 * 10**8], np.eye(1), np.ones(1), np.ones(1))
    assert wide.deviation(np.array([[0], [900]])) == [(5 * 10**8) ** 2, None]


def test_a_tree_of_many_parts(spark):
    rng = np.random.default_rng(1)
    y = np.floor(rng.normal(size=(400, 5)) * 64).astype(int)
    x = spark.createDataFrame([([int(c) for c in v],) for v in y], "x array<long>").repartition(40)
    whole = whitening.merged_parts(x, 5)
    assert whole.n == 400 and np.allclose(whole.root.T @ whole.root, np.cov(y.T, bias=True) * 400)
