"""A byte-level convolutional network for text quality, trained and run in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of `CHUNK` bytes that cover
all of it. Bytes are embedded, learned filters of `WIDTH` bytes go over each chunk
in steps of `STRIDE` bytes, and each filter's largest response in the chunk is
kept. The mean and the largest of these over all chunks of the text go through one
hidden layer into one probability, in training as in scoring. Nothing but the text
is an input.

Training uses a sample of at most `SAMPLE_ROWS` labelled documents: the first by a
hash of doc_id and text of those that have both a label and a text, each whole,
whatever its length. Should they hold more than `SAMPLE_BYTES` in all, those that
no longer fit are left out. Scoring reads every byte.

Defined cases: null or empty text is one chunk of padding and gets that score; a
null label is no label; with no labels of both kinds every score is the share of
label 1 (0.5 without labels); repeated rows are scored alike; a null doc_id isn't
held out; a null text never trains; other columns, whatever their names, are
ignored, or kept where documents are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.flat import release, texts_of
from papyra.llm.rows import quoted, text_struct
from papyra.plans.durable import one_worker_pool

CHUNK, STEP = 1024, 768
STRIDE, GROUPS, DIMS, FILTERS, HIDDEN = 4, 3, 4, 32, 16
WIDTH = STRIDE * GROUPS
PLACES = CHUNK // STRIDE - GROUPS + 1
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20
STEPS, BATCH = 1500, 48
#: Chunks whose responses are computed in one go.
SLAB = 128
THRESHOLD = 0.3
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def chunks_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every chunk, and the first chunk of each text (n+1)."""
    size = np.diff(off)
    n = np.maximum(1, -(-(size - CHUNK) // STEP) + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    start = np.repeat(off[:-1], n) + k * STEP
    return start, np.minimum(CHUNK, np.repeat(off[1:], n) - start), first


def bytes_at(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The chunks as rows, padded with 0."""
    place = np.arange(CHUNK)
    inside = place < size[:, None]
    return np.where(inside, data[np.minimum(start[:, None] + place, len(data) - 1)] if len(data) else 0, 0).astype(np.uint8)


class ByteConvolution:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "bytes": normal(256, DIMS, s=0.5),
            "filters": normal(GROUPS, STRIDE * DIMS, FILTERS, s=0.2),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN, s=0.15),
            "hidden0": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, s=0.25),
            "out0": np.zeros(1, np.float32),
        }

    def pooled(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        p, n = self.p, len(x)
        e = p["bytes"][x].reshape(n, CHUNK // STRIDE, STRIDE * DIMS)
        z = p["shift"] + sum(e[:, g : g + PLACES] @ p["filters"][g] for g in range(GROUPS))
        z *= (np.arange(PLACES) * STRIDE < np.maximum(size, 1)[:, None])[:, :, None]
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0), at

    def combined(self, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n = self.p, np.diff(first)[:, None]
        both = np.concatenate([np.add.reduceat(best, first[:-1]) / n, np.maximum.reduceat(best, first[:-1])], 1)
        h = np.maximum(both @ p["hidden"] + p["hidden0"], 0)
        return h @ p["out"] + p["out0"], h, both

    def gradients(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        slabs = [self.pooled(x[a : a + SLAB], size[a : a + SLAB]) for a in range(0, len(x), SLAB)]
        best, at = (np.concatenate(parts) for parts in zip(*slabs))
        logit, h, both = self.combined(best, first)
        d = ((1 / (1 + np.exp(-logit))) - label).astype(np.float32) / len(label)
        g = {"out": h.T @ d, "out0": d.sum(keepdims=True)}
        dh = np.outer(d, p["out"]) * (h > 0)
        g |= {"hidden": both.T @ dh, "hidden0": dh.sum(0)}
        dboth = dh @ p["hidden"].T
        text = np.repeat(np.arange(len(label)), np.diff(first))
        top = best == both[text, FILTERS:]
        share = np.add.reduceat(top.astype(np.float32), first[:-1])[text]
        dbest = dboth[text, :FILTERS] / np.diff(first)[text][:, None] + dboth[text, FILTERS:] * top / share
        dbest = dbest * (best > 0)
        g["shift"] = dbest.sum(0)
        seen = x[np.arange(len(x))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        e = p["bytes"][seen].reshape(len(x), FILTERS, GROUPS, STRIDE * DIMS)
        g["filters"] = np.einsum("nf,nfgk->gkf", dbest, e, optimize=True)
        de = (dbest[:, :, None, None] * p["filters"].transpose(2, 0, 1)).reshape(-1, DIMS)
        flat = seen.reshape(-1)
        g["bytes"] = np.stack([np.bincount(flat, de[:, k], 256) for k in range(DIMS)], 1).astype(np.float32)
        return g

    def fit(self, texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = 11) -> ByteConvolution:
        y = np.array(labels, np.float32)
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or not 0 < share < 1:
            self.constant = share
            return self
        self.p["out0"][:] = np.log(share / (1 - share))
        data, off = texts_of(pa.array(texts, pa.string()))
        start, size, first = chunks_of(data, off)
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            who = r.integers(0, len(y), BATCH)
            pick = [np.arange(first[i], first[i + 1]) for i in who]
            c = np.concatenate(pick)
            g = self.gradients(bytes_at(data, start[c], size[c]), size[c], np.concatenate([[0], np.cumsum([len(q) for q in pick])]), y[who])
            rate = 0.004 * min(1, t / 50) * (1 - 0.9 * t / steps)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    constant: float | None = None

    def scores(self, column) -> np.ndarray:
        """Probability of label 1 for each text of an Arrow column."""
        data, off = texts_of(column)
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        start, size, first = chunks_of(data, off)
        best = [self.pooled(bytes_at(data, start[a : a + SLAB], size[a : a + SLAB]), size[a : a + SLAB])[0] for a in range(0, len(start), SLAB)]
        if not best:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.combined(np.concatenate(best), first)[0].astype(np.float64)))


def remainder(modulus: int, key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % modulus


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> ByteConvolution:
    """Fits on a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & (remainder(5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("size"), "text")
    drawn = texts.drop("text").join(known, "doc_id").dropDuplicates(["h"]).orderBy("h").limit(sample_rows).collect()
    chosen, left = [], sample_bytes
    for r in drawn:
        if r["size"] <= left:
            chosen.append((r["h"], int(r["quality"])))
            left -= r["size"]
    if not chosen:
        return ByteConvolution().fit([], [])
    # At most sample_rows hashes are sent, and at most sample_bytes of text come back.
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long, quality int"))
    rows = texts.join(wanted, "h").groupBy("h").agg(F.first("text").alias("text"), F.first("quality").alias("quality")).orderBy("h").collect()
    return ByteConvolution().fit([r["text"] for r in rows], [r["quality"] for r in rows])


def _scored(docs: DataFrame, model: ByteConvolution) -> DataFrame:
    """row (a struct of the columns of docs), score."""
    one_worker_pool(docs.sparkSession)

    def run(batches):
        for b in batches:
            row = b.column(0)
            yield pa.RecordBatch.from_arrays([row, pa.array(model.scores(row.field("text")))], names=["row", "score"])
            release()

    text = F.col("text").cast("string")
    return docs.select(F.struct(*(text.alias(c) if c == "text" else F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row")).mapInArrow(run, f"row {text_struct(docs)}, score double")


def score_quality(docs: DataFrame, model: ByteConvolution, name: str = "score") -> DataFrame:
    """The rows of docs with their score in a column of that name, in place of any such column."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != name]
    return _scored(docs, model).select(*kept, F.col("score").alias(name))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = _scored(docs.select("doc_id", "text"), train_quality(docs, labels)).select("row.doc_id", "score")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all columns."""
    return _scored(docs, train_quality(docs, labels)).where(F.col("score") >= threshold).select("row.*")
