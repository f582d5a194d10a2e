"""Near-copies: unbiased signatures, classes against brute force."""

import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import nearcopies
from papyra.llm.nearcopies import near_copies, signatures, without_copies


def test_signatures_estimate_weighted_similarity():
    r, a, b = np.random.default_rng(1), [], []
    for _ in range(40):
        x, z = r.integers(0, 2**63, 300).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
        one = np.ones(300)
        s = signatures(np.concatenate([x[:200], z, x]), np.concatenate([one, one]), np.array([0, 300, 600]))
        a.append((s[0] == s[1]).mean())
        u, v = r.integers(1, 9, 300).astype(float), r.integers(1, 9, 300).astype(float)
        s = signatures(np.concatenate([x, x]), np.concatenate([u, v]), np.array([0, 300, 600]))
        b.append((s[0] == s[1]).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum())
    assert abs(np.mean(a) - 0.5) < 0.03 and abs(np.mean(b)) < 0.03


def brute(rows):
    sets = []
    for d, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    classes = {}
    for i, (d, _, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    least = lambda ds: min((d for d in ds if d is not None), default=None)
    return sorted(((d, least(classes[find(i)])) for i, (d, _, _) in enumerate(rows)), key=str)


def group(n):
    """A base with many copies, each changed in a few places, and a chain of drifting texts."""
    r = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(n):
        w = base[:]
        for i in r.integers(0, 150, 2):
            w[i] = f"c{k}_{i}"
        rows.append((1000 + k, " ".join(w), "a"))
    drift = [f"d{i}" for i in range(200)]
    for k in range(12):
        drift[15 * k : 15 * k + 2] = [f"e{k}", f"f{k}"]
        rows.append((3000 + k, " ".join(drift), "a"))
    return rows


def test_classes(docs, rows):
    got = near_copies(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == brute(rows)


def test_large_groups(make, monkeypatch):
    rows = group(80)
    want = brute(rows)
    for small in (8, 2):
        monkeypatch.setattr(nearcopies, "SMALL", small)
        assert sorted(((r["doc_id"], r["class_id"]) for r in near_copies(make(rows)).collect()), key=str) == want


def family(name, n):
    """Texts of one base with four edits each, all less than 0.8 alike, and a pair of 0.81 that shares only what the base has too."""
    r = np.random.default_rng(len(name))
    base = [f"{name}{i}" for i in range(150)]
    texts = []
    for k in range(n):
        w = base[:]
        for i in range(4):
            w[int(r.integers(5, 32)) + 37 * i] = f"{name}c{k}_{i}"
        texts.append(" ".join(w))
    one, two = base[:], base[:]
    one[75] = f"{name}one"
    two[40] = two[110] = f"{name}two"
    return texts + [" ".join(one), " ".join(two)]


def test_lone_links_in_large_buckets(make):
    rows = [(10000 * k + i, t, "a") for k, name in enumerate(["f", "gg"]) for i, t in enumerate(family(name, 2500))]
    got = {r["doc_id"]: r["class_id"] for r in near_copies(make(rows)).collect()}
    assert {d: c for d, c in got.items() if d != c} == {2501: 2500, 12501: 12500}


def test_blocks_count_as_similarity_does(monkeypatch):
    monkeypatch.setattr(nearcopies, "SLAB", 16)
    r = np.random.default_rng(3)
    for most in (1, 4):
        sets = [(np.sort(r.choice(np.arange(150, dtype=np.uint32), int(n), replace=False)), r.integers(1, most + 1, int(n)).astype(np.uint32)) for n in r.integers(0, 120, 40)]
        packed = [(n.tobytes(), w.tobytes() if most > 1 else b"") for n, w in sets]
        elements = [nearcopies._elements(*p) for p in packed]
        both = nearcopies.in_both(elements[:15], elements[15:])
        for i, j in np.ndindex(both.shape):
            (x, u), (y, v) = packed[i], packed[15 + j]
            assert both[i, j] / max(1, len(elements[i]) + len(elements[15 + j]) - both[i, j]) == nearcopies.similarity(x, y, u, v)


def test_blocks_of_several_parts(make, monkeypatch):
    rows = group(80)
    want = brute(rows)
    monkeypatch.setattr(nearcopies, "SMALL", 2)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    for counts in (False, True):
        assert sorted(((r["doc_id"], r["class_id"]) for r in near_copies(make(rows), counts=counts).collect()), key=str) == want


def test_one_of_each_class_stays(docs, rows):
    out = without_copies(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 6 in ids and 7 not in ids and 8 not in ids and {1, 2, 3, 4} <= set(ids) and 18 not in ids


def test_names_may_clash(docs):
    other = docs
    for c in ("_h", "_d", "h", "id", "own", "row"):
        other = other.withColumn(c, F.lit("x"))
    out = without_copies(other)
    assert out.columns == other.columns
    got = out.collect()
    assert {r[c] for r in got for c in ("_h", "_d", "h", "id", "own", "row")} == {"x"}
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r["doc_id"] for r in without_copies(docs).collect()), key=str)


def test_empty(nothing, docs):
    assert near_copies(nothing).collect() == [] and without_copies(nothing).collect() == []
    assert sorted(r["class_id"] for r in near_copies(docs.where("doc_id in (1, 2, 3)")).collect()) == [1, 2, 3]
