"""Language-model scores: counts against brute force, a normalised model that beats the base."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from papyra.llm import lm
from papyra.llm.flat import U, mix, word_names, words_of
from papyra.llm.lm import END, ClassModel, Pass, first_fit, fit, held_out, lm_scores, token_counts


def brute(rows):
    end = object()
    tokens = [(d, [w.lower() if w.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [end]) for d, t, _ in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((d is None, d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in tokens), key=str)


@pytest.mark.parametrize("vocabulary", [1024, 5])
def test_counts(docs, rows, monkeypatch, vocabulary):
    monkeypatch.setattr(lm, "VOCABULARY", vocabulary)
    got = lm_scores(docs).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == brute(rows)
    assert all(r["score"] < 0 for r in got)


def table(p, c2):
    """Log10 probabilities [c1, w] after c2, plainly."""
    s = (p["r1"] + p["r2"][c2]).astype(float) @ p["q"].T.astype(float) + p["b"]
    return (s - np.log(np.exp(s).sum(1, keepdims=True))) / math.log(10)


def test_model_is_normalised_and_learns():
    pairs = np.zeros((6, 6), np.int64)
    for i in range(6):
        pairs[i, (i + 1) % 6] = 900
        pairs[i, i] = 100
    t = table(first_fit(pairs), 0)
    assert all(t[i].argmax() == (i + 1) % 6 for i in range(6))


def test_a_pass_learns_the_second_context():
    """The next class is the one two before."""
    r, start = np.random.default_rng(0), first_fit(np.full((6, 6), 100))
    own = Pass(start, np.full(6, 1 / 6), 0)
    for _ in range(400):
        c2 = r.integers(0, 6, 512)
        own.batch(c2, r.integers(0, 6, 512), c2)
    assert all((table(own.p, c).argmax(1) == c).all() for c in range(6))
    model = ClassModel(np.sort(np.append(np.arange(1, 6).astype(np.uint64), END)), own.p, np.zeros(256, int), np.zeros(256, int))
    c2, c1, w = r.integers(0, 6, (3, 200))
    want = [table(own.p, x)[y, z] for x, y, z in zip(c2, c1, w)]
    assert np.allclose(model.class_scores(c2, c1, w), want, atol=1e-5)


def plain_batch(own, other, c2, c1, w):
    """The parameters after one batch, by the formulas, in double precision."""
    p = {k: v.astype(float) for k, v in own.p.items()}
    h, log_noise = p["r1"][c1] + p["r2"][c2], own.log_noise.astype(float)
    d = 1 / (1 + np.exp(log_noise[w] - (h * p["q"][w]).sum(1) - p["b"][w])) - 1
    e = 1 / (1 + np.exp(log_noise[other] - h @ p["q"][other].T - p["b"][other]))
    dh = d[:, None] * p["q"][w] + e @ p["q"][other]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    for k, at, x in (("r1", c1, dh), ("r2", c2, dh), ("q", w, d[:, None] * h), ("q", other, e.T @ h), ("b", w, d), ("b", other, e.sum(0))):
        np.add.at(g[k], at, x / len(w))
    return {k: p[k] - lm.RATE * g[k] / np.sqrt(own.square[k] + g[k] ** 2) for k in p}


def test_a_batch_is_worked_on_in_small_parts():
    """The same step as by the formulas, but neither all its noise nor all classes are held at once."""
    r, k = np.random.default_rng(3), 2048
    start = {c: r.standard_normal((k, lm.DIMS)).astype(np.float32) for c in ("r1", "r2", "q")} | {"b": r.standard_normal(k).astype(np.float32)}
    noise = r.random(k) + 0.1
    own = Pass(start, noise / noise.sum(), 7)
    c2, c1, w = (k * r.random((3, lm.BATCH)) ** 3).astype(np.int64)
    other = np.minimum(np.searchsorted(own.heap, np.random.default_rng(7).random(lm.SHARED)), k - 1)
    want = plain_batch(own, other, c2, c1, w)
    tracemalloc.start()
    own.batch(c2, c1, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.allclose(own.p[c], want[c], atol=1e-3) for c in want) and own.tokens == lm.BATCH
    assert peak < 10 * lm.BATCH * lm.SHARED


def test_names_are_made_in_small_parts():
    """The names of flat, also of words longer than a part; memory follows the parts, not the text."""
    r = np.random.default_rng(1)
    for n, white in ((0, 0.2), (1, 0.2), (50, 0.2), (300_000, 0.2), (300_000, 2e-5), (200_000, 0.0)):
        data = np.where(r.random(n) < white, 32, r.integers(33, 256, n)).astype(np.uint8)
        s, e, _ = words_of(data, np.array([0, n]))
        assert (lm.names_of(data, s, e) == word_names(data, s, e)).all()
    data = np.where(r.random(4 << 20) < 0.2, 32, 97).astype(np.uint8)
    s, e, _ = words_of(data, np.array([0, len(data)]))
    tracemalloc.start()
    lm.names_of(data, s, e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)


def test_score_against_plain_recomputation(docs, rows, monkeypatch):
    """Classes from counts by hand, probabilities from the model's parameters, token by token."""
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    training = docs.where(~held_out()).selectExpr("coalesce(text, '') text")
    model, n, v = fit(training, token_counts(training, 8), 8)
    lower = lambda w: re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
    tokens = [(d, [lower(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]) for d, t, _ in rows]
    c = Counter(w for d, ws in tokens if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    assert (n, v) == (sum(c.values()), len(c))
    vocabulary = model.vocabulary.tolist()

    def class_of(w):
        name = END[0] if w is None else word_names(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        if name in vocabulary:
            return vocabulary.index(name)
        tail = [U(x) for x in (w[::-1][:3] + bytes(3))[:3]]
        return len(vocabulary) + int(mix(np.array([tail[0] | tail[1] << U(8) | tail[2] << U(16)]))[0] % U(256))

    classes = {w: class_of(w) for _, ws in tokens for w in ws}
    words, total = Counter(classes[w] for w in c), Counter()
    for w, k in c.items():
        total[classes[w]] += k
    assert sum(k < len(vocabulary) for k in words) == len([w for w in c if classes[w] < len(vocabulary)]) >= 40
    tables = {}
    want = []
    for d, ws in tokens:
        x = y = model.end
        s = 0.0
        for w in ws if len(ws) < 2000 else []:
            k = classes[w]
            if x not in tables:
                tables[x] = table(model.p, x)
            s += tables[x][y, k]
            if k >= len(vocabulary):
                s += math.log10((c[w] + 1) / (total[k] + words[k] + 1))
            x, y = y, k
        want.append((d, len(ws), s))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in lm_scores(docs).collect() if r["n_tokens"] < 2000)
    want = sorted((d is not None, d or 0, n, s) for d, n, s in want if n < 2000)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) / w[2] for g, w in zip(got, want)) < 1e-3


def test_better_than_base(spark):
    r = lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("score", "base_score").first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_empty(nothing, docs):
    assert lm_scores(nothing).collect() == []
    only_held = docs.where("crc32(cast(doc_id as string)) % 7 = 2")
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in lm_scores(only_held).collect())
