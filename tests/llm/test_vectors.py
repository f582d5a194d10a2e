"""Embedding near-copies and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from papyra.llm import graph_search, subspaces
from papyra.llm.graph_search import nearest
from papyra.llm.subspaces import vector_copies

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, cell long"


def vectors(n=300, d=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    x[50:80] = x[50] + 0.05 * r.standard_normal((30, d))
    x[100:110] = x[100]
    x[110:115] = 2 * x[100]
    rows = [(i * 5, x[i].astype(np.float32).tolist()) for i in range(n)]
    return rows + [(7, None), (8, []), (9, [0.0] * d), (11, [1.0, None] + [0.0] * (d - 2)), (12, [math.nan] * d), (13, [math.inf] + [1.0] * (d - 1)), (None, x[3].astype(np.float32).tolist()), (15, x[4].tolist()), (21, [1.0, 2.0]), (22, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, "x", 0) for i, v in rows], SCHEMA)


def part(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if part(v)]
    x = {k: np.float32(rows[k][1]).astype(float) for k in ok}
    link = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine:
                link[a].append(b)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in ok:
            m = min([label[a], *(label[b] for b in link[a])])
            changed |= m < label[a]
            label[a] = m
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, len(link[k]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(8192, 16384, 4096), (7, 11, 20)])
def test_links_and_components(spark, monkeypatch, sizes):
    for name, n in zip(("STANDING", "VISITING", "CELL_NODES"), sizes):
        monkeypatch.setattr(subspaces, name, n)
    rows = vectors()
    rows.append(rows[0])
    got = vector_copies(frame(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def exact(rows, queries, k):
    ok = {i: np.float32(v).astype(float) for i, v in rows if part(v) and i is not None}
    out = {}
    for q in queries:
        s = sorted((-(ok[q] @ v) / math.sqrt((ok[q] @ ok[q]) * (v @ v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out[q] = [(i, -c) for c, i in s[:k]]
    return out


def test_recall_ties_and_scores(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARD", 120)
    monkeypatch.setattr(graph_search, "QUERIES", 10)
    rows = vectors()
    f = frame(spark, rows)
    got = nearest(f, f.where("vec_id % 50 = 0"), 5).collect()
    want = exact(rows, [i for i, v in rows if i is not None and i % 50 == 0 and part(v)], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(want)
    assert all([x[1] for x in v] == sorted((x[1] for x in v), reverse=True) and len(v) == 5 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {(q, i): c for q, v in want.items() for i, c in v}
    assert all(abs(c - scores[q, i]) < 1e-12 for q, v in found.items() for i, c in v if (q, i) in scores)
    # Ten equal vectors and five of twice their length: the smallest ids come first.
    assert [i for i, _ in found[500]] == [i for i, _ in want[500]]


def test_recall_on_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in v.select("vec_id", "embedding").collect()]
    got = nearest(v, v.where("vec_id % 50 = 0"), 5).collect()
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert sum(any(r["vec_id"] == i for i, _ in want[r["query_id"]]) for r in got) >= 0.9 * 5 * len(want)


def test_empty(spark):
    f = frame(spark, [])
    assert vector_copies(f).collect() == [] and nearest(f, f, 5).collect() == []
    two = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [(r["query_id"], r["vec_id"]) for r in nearest(two, two.where("vec_id = 0"), 5).collect()] == [(0, 1)]


def test_searches_score_few_nodes():
    r = np.random.default_rng(4)
    x = r.standard_normal((15_000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = graph_search.Graph(x).build()
    q = x[:: len(x) // 200]
    found, _ = g.search(q, graph_search.BEAM)
    want = np.argsort(-(q @ x.T), 1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, want)]) >= 0.9
    assert g.scored < 0.1 * len(q) * len(x)
    # Pruned edges: within the degree, to others, none twice.
    for i in range(0, len(x), 500):
        e = g.edges[i][g.edges[i] >= 0].tolist()
        assert 0 < len(e) <= graph_search.DEGREE and i not in e and len(set(e)) == len(e)


def test_one_id_with_unlike_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    runs = [sorted(map(tuple, nearest(frame(spark, some), frame(spark, some).where("vec_id = 0"), 2).collect())) for some in (rows, rows[::-1])]
    assert runs[0] == runs[1] and {r[2] for r in runs[0]} == {1, 2}
