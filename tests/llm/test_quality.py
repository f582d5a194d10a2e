"""The byte network: gradients, held-out accuracy, whole texts."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from papyra.llm.quality import CHUNK, DIMS, FILTERS, PLACES, STEP, STRIDE, ByteConvolution, bytes_at, chunks_of, good_documents, quality_scores, score_quality, train_quality
from papyra.llm.flat import texts_of


def test_chunks_cover_texts():
    data, off = texts_of(pa.array(["", "a", "b" * CHUNK, "c" * (CHUNK + 1), "d" * 5000, None]))
    start, size, first = chunks_of(data, off)
    for i in range(len(off) - 1):
        seen = np.zeros(off[i + 1] - off[i], bool)
        for k in range(first[i], first[i + 1]):
            seen[start[k] - off[i] : start[k] - off[i] + size[k]] = True
        assert seen.all() and first[i + 1] - first[i] >= 1
    assert STEP < CHUNK


def test_gradients():
    m, r = ByteConvolution(), np.random.default_rng(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    data, off = texts_of(pa.array(["".join(chr(c) for c in r.integers(97, 123, 1500)), "abc", "zz!! " * 60]))
    start, size, first = chunks_of(data, off)
    x, y = bytes_at(data, start, size), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean(np.logaddexp(0, (z := m.combined(m.pooled(x, size)[0], first)[0])) - y * z))
    g = m.gradients(x, size, first, y)
    for k in ("bytes", "filters", "hidden", "out"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        at, e = m.p[k][i], 1e-5
        m.p[k][i] = at + e
        up = loss()
        m.p[k][i] = at - e
        down = loss()
        m.p[k][i] = at
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-3 * max(1e-2, abs(g[k][i])) + 1e-5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in r]) >= 0.9
    assert np.mean([x["predicted"] for x in r if x["quality"] == 1]) >= 0.95


def test_every_byte_counts():
    m = ByteConvolution().fit(["good words here " * 20, "!! ## $$ " * 30] * 20, [1, 0] * 20, steps=60)
    a, b = m.scores(pa.array(["good words here " * 500, "good words here " * 500 + "!! ## $$ " * 400]))
    assert a > b


def plain(m, text):
    """The score of one text, filter by filter and place by place."""
    raw, p, best = (text or "").encode(), {k: v.astype(np.float64) for k, v in m.p.items()}, []
    for a in range(0, max(1, len(raw) - CHUNK + STEP), STEP):
        chunk = raw[a : a + CHUNK]
        x = np.concatenate([p["bytes"][b] for b in chunk.ljust(CHUNK, b"\0")])
        own = []
        for f in range(FILTERS):
            w = p["filters"][:, :, f].reshape(-1)
            own.append(max(0.0, *(x[k * STRIDE * DIMS : k * STRIDE * DIMS + len(w)] @ w + p["shift"][f] for k in range(PLACES) if k * STRIDE < max(1, len(chunk)))))
        best.append(own)
    both = np.concatenate([np.mean(best, 0), np.max(best, 0)])
    return 1 / (1 + np.exp(-(np.maximum(both @ p["hidden"] + p["hidden0"], 0) @ p["out"] + p["out0"][0])))


def test_query_against_plain_scores(spark, docs, rows):
    """The same sample, drawn by hand, gives the model whose plain scores the query returns."""
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(100, 130)] + [(11, 1, 0), (12, 0, 0), (555, 1, 0)], "doc_id long, quality int, toxic int")
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    sample = sorted((h[d], t, q) for d, t, _ in rows for i, q in [(r["doc_id"], r["quality"]) for r in labels.collect()] if i == d and zlib.crc32(str(d).encode()) % 5)
    m = ByteConvolution().fit([t for _, t, _ in sample], [q for _, _, q in sample])
    got = {(r["doc_id"], round(r["score"], 4)) for r in quality_scores(docs, labels).collect()}
    assert got == {(d, round(float(m.scores(pa.array([t], pa.string()))[0]), 4)) for d, t, _ in rows}
    for d, t, _ in rows[:10] + rows[11:20]:
        assert abs(plain(m, t) - m.scores(pa.array([t], pa.string()))[0]) < 1e-4


def test_sample_is_bounded_and_whole(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5000, 5050)] + [(i, i % 2, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")
    assert train_quality(docs, labels, sample_rows=20).constant is None
    assert train_quality(docs, labels, sample_bytes=10).constant == 0.5


def test_names_may_clash(docs, spark):
    other = docs.withColumn("_score", F.lit("x")).withColumn("row", F.lit("y")).withColumn("a.b", F.lit("z"))
    out = good_documents(other, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.columns == other.columns and {(r["_score"], r["row"], r["a.b"], r["score"]) for r in out.collect()} == {("x", "y", "z", "x")}


def test_edge_cases(spark, docs, nothing):
    labels = spark.createDataFrame([(4, 1, None), (6, 0, 0), (9, 1, 0), (None, None, None), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert quality_scores(nothing, labels.limit(0)).collect() == []
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    out = score_quality(docs, ByteConvolution())
    assert sorted(out.columns) == sorted(docs.columns)
    assert good_documents(docs, labels.limit(0)).columns == docs.columns
