"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are a document's words with A-Z lowered, then one end. Token counts are
gathered from all training documents (see slices): every slice of the corpus
asks buckets of words for the counts of its own distinct words, so no word list
is ever whole in one place. The model predicts the *class* of the next token from
the classes of the two before: the `VOCABULARY` commonest tokens are classes of
their own, all others fall into `RARE` classes by their last bytes, inside which a
token has probability (c + 1) / (N + V + 1) with the class's counts.

The model is s(w | c2, c1) = (r1[c1] + r2[c2]) . q[w] + b[w], a projection for each
position of the context. Training tells tokens from noise drawn from the class
frequencies, in two steps. First r1, q and b are fitted on the driver to the table
of class pairs of all training documents, which has a fixed size. From there every
partition of the training documents goes once over all its tokens, with noise
shared by a batch, and the partitions' parameters are averaged by their tokens; so
what training sees grows with the corpus. As exp(s) is a product of a factor of
(c1, w) and one of (c2, w), one matrix product gives the normaliser of every pair
of contexts, and log-probabilities are exactly normalised.

Defined cases: null text is empty, an empty text is one end token; a null doc_id
is a training row; no training rows give N = 0 and a uniform class model;
repeated rows count again; other columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.flat import BASE, BYTE_CODE, ODD, U, mix, release, texts_of, words_of
from papyra.llm.slices import ASKS, ASKS_ARROW, Sliced, packed, told
from papyra.plans.durable import checkpointed

VOCABULARY, RARE, DIMS = 1792, 256, 32
NOISE, STEPS, BATCH = 8, 600, 4096
#: Noise shared by a batch of tokens in the pass over the corpus, and its first step.
SHARED, RATE = 96, 0.05
#: Rows of a batch whose noise is worked on at once, and bytes of text that are named at once: as much as a core's cache holds.
ROWS, NAMED = 512, 1 << 16
#: Parts of the table of class pairs, and how many summaries one task merges.
PARTS, FAN = 16, 32
CLASS_SHIFT = U(56)
COUNT = (U(1) << CLASS_SHIFT) - U(1)
END = mix(np.array([0x454E44], np.uint64))
_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse; kept, unless for a word longer than NAMED."""
    made = _powers
    if len(made[0]) < n:
        made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, NAMED) - 1, x))]) for x in (BASE, U(pow(int(BASE), -1, 1 << 64)))]
        if n <= NAMED:
            _powers[:] = made
    return made


def names_of(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """flat.word_names of words in order, from sums over all bytes before: a word's is divided by the power at its start."""
    out, i = np.empty(len(s), np.uint64), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + NAMED, "right")))
        lo, hi = s[i], e[j - 1]
        up, down = _powers_of(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE_CODE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        at = s[i:j] - lo
        out[i:j] = (sums[e[i:j] - lo] - sums[at]) * down[at] + (e[i:j] - s[i:j]).astype(np.uint64) * ODD
        i = j
    return mix(out)


def _groups(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the names, in no given order among equal ones, and starts of the groups of these."""
    order = np.argsort(names)
    s = names[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]]))


class _Tokens:
    """Names, rare classes and documents of all tokens of a table, ends included."""

    def __init__(self, column):
        data, off = texts_of(column)
        self.data = np.frombuffer(data.tobytes().translate(_lower), np.uint8)
        self.s, self.e, first = words_of(self.data, off)
        n = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.word = np.ones(self.first[-1], bool)
        self.word[self.first[1:] - 1] = False
        self.names = np.full(self.first[-1], END[0])
        self.names[self.word] = names_of(self.data, self.s, self.e)

    @cached_property
    def rare(self) -> np.ndarray:
        rare, s, e, data = np.zeros(len(self.names), np.int64), self.s, self.e, self.data
        if len(s):
            tail = data[e - 1].astype(np.uint64)
            for k in (2, 3):
                tail |= np.where(e - k >= s, data[np.maximum(e - k, 0)], 0).astype(np.uint64) << U(8 * k - 8)
            rare[self.word] = (mix(tail) % U(RARE)).astype(np.int64)
        return rare

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        return _groups(self.names)

    def places(self, names: np.ndarray) -> np.ndarray:
        """Where the sorted names have each token, or -1; each distinct token is looked up once."""
        order, start = self.groups
        own, out = self.names[order[start]], np.empty(len(self.names), np.int64)
        k = np.minimum(np.searchsorted(names, own), len(names) - 1)
        out[order] = np.repeat(np.where(names[k] == own, k, -1), np.diff(np.append(start, len(order))))
        return out

    def classes(self, vocabulary: np.ndarray) -> np.ndarray:
        k = self.places(vocabulary)
        return np.where(k >= 0, k, len(vocabulary) + self.rare)

    def before(self, classes: np.ndarray, end: int) -> np.ndarray:
        """What stands before each token: an end before a document's first; of these again, what stands two before."""
        c = np.empty_like(classes)
        c[1:] = classes[:-1]
        c[self.first[:-1]] = end
        return c


def _ask(table, said):
    """Each distinct token of a slice."""
    t = _Tokens(table.column("text"))
    order, start = t.groups
    names = t.names[order[start]]
    yield 0, names, np.zeros_like(names)


def _local_counts(buckets: int):
    """Counts of the tokens of a partition of training texts, with their rare classes, by bucket."""

    def run(batches):
        names, more = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                t = _Tokens(b.column(0).slice(a, 512))
                order, start = t.groups
                n = np.diff(np.append(start, len(order))).astype(np.uint64)
                names, more = _added(np.concatenate([names, t.names[order[start]]]), np.concatenate([more, n | t.rare[order[start]].astype(np.uint64) << CLASS_SHIFT]))
        yield from _packed_rows(names, more, buckets)
        release()

    return run


def _added(names, more):
    order, start, total = _sums(names, more)
    return names[order[start]], total | more[order[start]] & ~COUNT


def _packed_rows(names, more, buckets):
    rows = packed(-1, 0, names, more, buckets)
    if rows:
        yield from pa.Table.from_pylist(rows, schema=ASKS_ARROW).to_batches()


def _global_counts(buckets: int):
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield from _packed_rows(*_added(*(np.frombuffer(b"".join(r[c] for r in rows), np.uint64) for c in ("names", "more"))), buckets)

    return run


def _sums(names, more):
    order, start = _groups(names)
    return order, start, np.add.reduceat(more[order] & COUNT, start)


def _count(kind, names, who, more):
    """Says the count of each token that has one to the slices that ask; the counts come as from slice -1."""
    order, start, total = _sums(names, more)
    total = np.repeat(total, np.diff(np.append(start, len(order))))
    asks = (total > 0) & (who[order] >= 0)
    return order[asks], names[order][asks], total[asks]


def _totals(batches):
    """Of the tokens of a bucket: how many and how often in each rare class, and the commonest."""
    for b in batches:
        for r in b.to_pylist():
            names, more = np.frombuffer(r["names"], np.uint64), np.frombuffer(r["more"], np.uint64)
            rare, total = (more >> CLASS_SHIFT).astype(np.int64), more & COUNT
            v, n = np.bincount(rare, minlength=RARE), np.bincount(rare, total.astype(float), RARE).astype(np.int64)
            yield _summary(r["bucket"] // FAN, v, n, names, total, rare)


def _summary(part, v, n, names, total, rare):
    best = np.lexsort((names, -total.astype(np.int64)))[:VOCABULARY]
    best = best[total[best] > 0]
    arrays = (v, n, names[best], total[best], rare[best].astype(np.int64))
    return pa.record_batch([pa.array([part], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["part", "v", "n", "names", "total", "rare"])


def _merged(table):
    v, n, names, total, rare = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("v", np.int64), ("n", np.int64), ("names", np.uint64), ("total", np.uint64), ("rare", np.int64)))
    return v.reshape(-1, RARE).sum(0), n.reshape(-1, RARE).sum(0), names, total, rare


def _merge(key, table):
    v, n, names, total, rare = _merged(table)
    return pa.Table.from_batches([_summary(key[0].as_py(), v, n, names, total, rare)])


def _tree(df: DataFrame, merge, schema: str, n: int) -> pa.Table:
    """Merges rows whose `part` is below n / FAN, FAN by FAN, until the driver takes the few that are left."""
    while True:
        df = df.groupBy("part").applyInArrow(merge, schema)
        n = -(-n // FAN)
        if n <= FAN:
            return df.toArrow()
        df = df.withColumn("part", F.expr(f"part div {FAN}").cast("int"))


class ClassModel:
    """The trained classes: vocabulary, parameters, log normalisers [c2, c1], and what rare classes hold."""

    def __init__(self, vocabulary: np.ndarray, p: dict[str, np.ndarray], rare_v: np.ndarray, rare_n: np.ndarray):
        self.vocabulary, self.p, self.rare_v, self.rare_n = vocabulary, p, rare_v, rare_n
        near, far = (p[r].astype(np.float64) @ p["q"].T.astype(np.float64) for r in ("r1", "r2"))
        near += p["b"]
        top = near.max(1), far.max(1)
        z = np.exp(far - top[1][:, None]) @ np.exp(near - top[0][:, None]).T
        self.log_z = (np.log(z) + top[1][:, None] + top[0][None, :]).astype(np.float32)
        self.end = int(np.searchsorted(vocabulary, END[0]))
        self.rare_log = np.log10(rare_v + rare_n + 1.0)

    def class_scores(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log10 probability of each class w after c2, c1."""
        p, out = self.p, np.empty(len(w))
        for a in range(0, len(w), 1 << 15):
            x, y, z = (v[a : a + (1 << 15)] for v in (c2, c1, w))
            out[a : a + (1 << 15)] = np.einsum("ij,ij->i", p["r1"][y] + p["r2"][x], p["q"][z]) + p["b"][z] - self.log_z[x, y]
        return out / np.log(10)


def first_fit(pairs: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters fitted to the counts [c1, w] of class pairs by noise-contrastive estimation; r2 is 0."""
    k, r = len(pairs), np.random.default_rng(seed)
    noise = noise_of(pairs.sum(0))
    context = (0.1 * r.standard_normal((k, DIMS))).astype(np.float32)
    target = (0.1 * r.standard_normal((k, DIMS))).astype(np.float32)
    bias = np.log(noise).astype(np.float32)
    flat = np.flatnonzero(pairs)
    if len(flat):
        weight = np.cumsum(pairs.reshape(-1)[flat].astype(np.float64))
        heap = np.cumsum(noise)
        log_noise = np.log(NOISE * noise).astype(np.float32)
        square = [np.full(x.shape, 1e-3, np.float32) for x in (context, target, bias)]
        for step in range(STEPS):
            at = flat[np.searchsorted(weight, r.random(BATCH) * weight[-1])]
            c, w = at // k, at % k
            words = np.concatenate([w[:, None], np.minimum(np.searchsorted(heap, r.random((BATCH, NOISE))), k - 1)], 1)
            x, y = context[c], target[words]
            d = 1 / (1 + np.exp(-(np.einsum("bd,bnd->bn", x, y) + bias[words] - log_noise[words])))
            d[:, 0] -= 1
            rate = 0.3 * (1 - step / STEPS) + 0.01
            for parts, (p, s), at_, g in (((k, DIMS), (context, square[0]), c, np.einsum("bn,bnd->bd", d, y)), ((k, DIMS), (target, square[1]), words.reshape(-1), (d[:, :, None] * x[:, None]).reshape(-1, DIMS)), ((k,), (bias, square[2]), words.reshape(-1), d.reshape(-1))):
                g = _scatter(at_, g, parts)
                s += (g / BATCH) ** 2
                p -= (rate * (g / BATCH) / np.sqrt(s)).astype(np.float32)
    return {"r1": context, "r2": np.zeros_like(context), "q": target, "b": bias}


def noise_of(counts: np.ndarray) -> np.ndarray:
    noise = counts + 0.5
    return noise / noise.sum()


class Pass:
    """One pass of noise-contrastive estimation over a partition's tokens, from given parameters."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.p, self.r, self.tokens = {k: v.copy() for k, v in p.items()}, np.random.default_rng(seed), 0
        self.heap, self.log_noise = np.cumsum(noise), np.log(SHARED * noise).astype(np.float32)
        self.square = {k: np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}

    def batch(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, len(w)
        other = np.minimum(np.searchsorted(self.heap, self.r.random(SHARED)), len(self.heap) - 1)
        h, q, o = p["r1"][c1], p["q"][w], p["q"][other]
        h += p["r2"][c2]
        d = 1 / (1 + np.exp(self.log_noise[w] - np.einsum("ij,ij->i", h, q) - p["b"][w])) - 1
        dh = q * d[:, None]
        # Of the noise, the logistic function of x is (1 + tanh(x / 2)) / 2, and the sums of the 1 are known.
        half, bias = np.ascontiguousarray(o.T) / 2, (p["b"][other] - self.log_noise[other]) / 2
        once, o_sum, o = np.ones(n, np.float32), o.sum(0) / 2, o / 2
        e_h, e_1, held = np.zeros_like(o), np.zeros(SHARED, np.float32), np.empty((min(n, ROWS), SHARED), np.float32)
        for i in range(0, n, ROWS):
            x = h[i : i + ROWS]
            e = np.matmul(x, half, out=held[: len(x)])
            e += bias
            np.tanh(e, out=e)
            dh[i : i + ROWS] += e @ o
            e_h += e.T @ x
            e_1 += once[: len(x)] @ e
        dh += o_sum
        e_h, e_1 = (e_h + h.sum(0)) / 2, (e_1 + n) / 2
        h *= d[:, None]
        at, q, b = _summed(np.concatenate([w, other]), np.concatenate([h, e_h]), np.concatenate([d, e_1]))
        self._step("q", at, q / n)
        self._step("b", at, b / n)
        for name, c in (("r1", c1), ("r2", c2)):
            at, g = _summed(c, dh)
            self._step(name, at, g / n)
        self.tokens += n

    def _step(self, name: str, at: np.ndarray, g: np.ndarray) -> None:
        square = self.square[name][at] + g * g
        self.square[name][at] = square
        self.p[name][at] -= RATE * g / np.sqrt(square)


_parameters = "part int, tokens long, p binary"


def _passes(vocabulary: np.ndarray, start: dict[str, np.ndarray], noise: np.ndarray):
    """Each partition's sum of parameters times tokens, and their merging."""
    end = int(np.searchsorted(vocabulary, END[0]))

    def run(batches):
        part = TaskContext.get().partitionId()
        own = Pass(start, noise, part)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                t = _Tokens(b.column(0).slice(a, 256))
                c = t.classes(vocabulary)
                c1 = t.before(c, end)
                c2 = t.before(c1, end)
                for i in range(0, len(c), BATCH):
                    own.batch(c2[i : i + BATCH], c1[i : i + BATCH], c[i : i + BATCH])
        if own.tokens:
            yield _weighed(part // FAN, own.tokens, np.concatenate([own.p[k].reshape(-1).astype(np.float64) * own.tokens for k in sorted(own.p)]))
        release()

    def merge(key, table):
        return pa.Table.from_batches([_weighed(key[0].as_py(), sum(table.column("tokens").to_pylist()), sum(np.frombuffer(p) for p in table.column("p").to_pylist()))])

    return run, merge


def _weighed(part: int, tokens: int, p: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([p.tobytes()], pa.binary())], names=["part", "tokens", "p"])


def _averaged(rows: pa.Table, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    tokens = sum(rows.column("tokens").to_pylist())
    if not tokens:
        return start
    flat, out, at = sum(np.frombuffer(p) for p in rows.column("p").to_pylist()) / tokens, {}, 0
    for k in sorted(start):
        out[k] = flat[at : at + start[k].size].reshape(start[k].shape).astype(np.float32)
        at += start[k].size
    return out


def _summed(at: np.ndarray, *g: np.ndarray) -> list[np.ndarray]:
    """The distinct indices, below 65,536, and for each the sum of its rows of each g."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    s = at[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    # Two columns at a time, as the parts of a complex number.
    return [s[first]] + [np.add.reduceat(x[order], first) if x.ndim == 1 else np.add.reduceat(x[order].view(np.complex64), first).view(np.float32) for x in g]


def _scatter(at: np.ndarray, g: np.ndarray, shape: tuple) -> np.ndarray:
    """Sums of the rows of g by index."""
    out = np.zeros(shape, np.float32)
    at, out[at] = _summed(at, g)
    return out


def _pairs(vocabulary: np.ndarray):
    k = len(vocabulary) + RARE
    end = int(np.searchsorted(vocabulary, END[0]))

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                t = _Tokens(b.column(0).slice(a, 256))
                c = t.classes(vocabulary)
                cells, n = np.unique(t.before(c, end) * k + c, return_counts=True)
                total[cells] += n
        cells = np.flatnonzero(total)
        for p in range(PARTS):
            own = cells[cells % PARTS == p]
            if len(own):
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([own.astype(np.int32).tobytes()], pa.binary()), pa.array([total[own].tobytes()], pa.binary())], names=["part", "cells", "n"])

    def merge(key, table):
        total = np.zeros(k * k, np.int64)
        for cells, n in zip(table.column("cells").to_pylist(), table.column("n").to_pylist()):
            total[np.frombuffer(cells, np.int32)] += np.frombuffer(n, np.int64)
        cells = np.flatnonzero(total)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells.astype(np.int32).tobytes()], pa.binary()), "n": pa.array([total[cells].tobytes()], pa.binary())})

    return run, merge


def _score(model: ClassModel, base_log: float, train_tokens: int):
    def run(table, said):
        t = _Tokens(table.column("text"))
        names, total = told(said, 0)
        count = np.zeros(len(t.names))
        if len(names):
            k = t.places(names)
            count = np.where(k >= 0, total[k], 0).astype(np.float64)
        c = t.classes(model.vocabulary)
        c1 = t.before(c, model.end)
        score = model.class_scores(t.before(c1, model.end), c1, c)
        rare = c >= len(model.vocabulary)
        score[rare] += np.log10(count[rare] + 1) - model.rare_log[t.rare[rare]]
        at, n = t.first[:-1], np.diff(t.first)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array(table.column("held_out").to_pylist(), pa.bool_()), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at), pa.int64()), "train_tokens": pa.array(np.full(len(n), train_tokens), pa.int64()),
            "base_score": pa.array(np.add.reduceat(np.log10(count + 1), at) - n * base_log), "score": pa.array(np.add.reduceat(score, at)),
        })

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def token_counts(training: DataFrame, buckets: int) -> DataFrame:
    """Count and rare class of every distinct token, packed by bucket."""
    return checkpointed(training.mapInArrow(_local_counts(buckets), ASKS).repartition(buckets, "bucket").mapInArrow(_global_counts(buckets), ASKS))


def fit(training: DataFrame, counts: DataFrame, buckets: int) -> tuple[ClassModel, int, int]:
    """The model, and how many tokens and distinct tokens it was trained on."""
    summary = "part int, v binary, n binary, names binary, total binary, rare binary"
    rare_v, rare_n, names, total, rare = _merged(_tree(counts.mapInArrow(_totals, summary), _merge, summary, buckets))
    best = np.lexsort((names, -total.astype(np.int64)))[:VOCABULARY]
    known = np.isin(names[best], END, invert=True)
    train_tokens, distinct = int(rare_n.sum()), int(rare_v.sum())
    # What is left for the rare classes once the commonest tokens have classes of their own.
    rare_v = rare_v - np.bincount(rare[best], minlength=RARE)
    rare_n = rare_n - np.bincount(rare[best], total[best].astype(float), RARE).astype(np.int64)
    if len(best) and known.all():  # the end is always a class; it may be rarer than the commonest words
        ends = training.count()
        rare_v[0] -= ends > 0
        rare_n[0] -= ends
    vocabulary = np.sort(np.concatenate([names[best][known], END]))
    run, merge = _pairs(vocabulary)
    schema = "part int, cells binary, n binary"
    cells = training.mapInArrow(run, schema).groupBy("part").applyInArrow(merge, schema).toArrow()
    k = len(vocabulary) + RARE
    pairs = np.zeros(k * k, np.int64)
    for c, m in zip(cells.column("cells").to_pylist(), cells.column("n").to_pylist()):
        pairs[np.frombuffer(c, np.int32)] += np.frombuffer(m, np.int64)
    pairs = pairs.reshape(k, k)
    start = first_fit(pairs)
    run, merge = _passes(vocabulary, start, noise_of(pairs.sum(0)))
    passed = training.mapInArrow(run, _parameters)
    p = _averaged(_tree(passed, merge, _parameters, training.rdd.getNumPartitions()), start)
    return ClassModel(vocabulary, p, rare_v, rare_n), train_tokens, distinct


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sliced = Sliced(docs)
    sliced.docs = sliced.docs.withColumn("held_out", held_out())
    n = sliced.buckets
    training = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = token_counts(training, n)
    model, train_tokens, distinct = fit(training, counts, n)
    said = sliced.answer(sliced.ask(_ask).union(counts), _count)
    return sliced.finish(_score(model, float(np.log10(train_tokens + distinct + 1)), train_tokens), RESULT, said)
