"""Questions and answers between slices of a corpus and buckets of names.

The documents are dealt once, by a hash of the row, over *slices* of a few MB of
text. A slice asks about the names (64-bit) that occur in it: each name once,
packed by *bucket* of the name into binary rows. A bucket answers every slice
that asked. A name that a third of all documents hold is asked about once per
slice, so no bucket gets hot, and only names travel, never the text again:
Spark reuses the one exchange of the text for each later step of the same plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.flat import release
from papyra.llm.rows import quoted
from papyra.plans.durable import one_worker_pool

#: Text bytes of a slice and of a bucket's share; the memory of a task follows these.
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
ASKS = "bucket int, slice long, kind int, names binary, more binary"
ANSWERS = "slice long, kind int, names binary, more binary"
ASKS_ARROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("names", pa.binary()), ("more", pa.binary())])
_answers = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("names", pa.binary()), ("more", pa.binary())])


class Sliced:
    """The documents as doc_id, text and their slice, and how many slices and buckets there are.

    The columns named in carry stay, in a struct `row`.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()):
        one_worker_pool(docs.sparkSession)
        size = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("b"), F.count(F.lit(1)).alias("n")).first()
        size = (size["b"] or 0) + 64 * size["n"]
        self.slices = max(1, math.ceil(size / SLICE_BYTES))
        self.buckets = max(8, math.ceil(size / BUCKET_BYTES))
        kept = [F.struct(*(F.col(quoted(c)) for c in carry)).alias("row")] if carry else []
        own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *kept)
        self.docs = own.withColumn("in", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.slices))).repartition(self.buckets, "in")

    def ask(self, f: Callable, answers: DataFrame | None = None) -> DataFrame:
        """f(table, answers table or None, buckets) yields (kind, names, more or None) for its slice."""
        n = self.buckets

        def question(key, table, said=None):
            out = []
            for kind, names, more in f(table, said):
                out += packed(key[0].as_py(), kind, names, more, n)
            release()
            return pa.Table.from_pylist(out, schema=ASKS_ARROW)

        return self._by_slice(question, answers, ASKS)

    def answer(self, asked: DataFrame, f: Callable) -> DataFrame:
        """f(kind, names, who, more) of all names of a bucket gives (indices of what to answer, names to say, more or None)."""

        def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            for kind in sorted({r["kind"] for r in rows}):
                own = [r for r in rows if r["kind"] == kind]
                keys = [np.frombuffer(r["names"], np.uint64) for r in own]
                size = [len(k) for k in keys]
                who = np.repeat(np.array([r["slice"] for r in own], np.int64), size)
                more = np.frombuffer(b"".join(r["more"] for r in own), np.uint64) if own[0]["more"] is not None else None
                at, say, extra = f(kind, np.concatenate(keys), who, more)
                who = who[at]
                order = np.argsort(who, kind="stable")
                who, say = who[order], say[order]
                extra = None if extra is None else extra[order]
                cut = np.flatnonzero(np.diff(who)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(who)]])
                if len(who):
                    yield from pa.Table.from_pylist([{"slice": int(who[a]), "kind": kind, "names": say[a:b].tobytes(), "more": None if extra is None else extra[a:b].tobytes()} for a, b in zip(lo, hi)], schema=_answers).to_batches()

            release()

        return asked.repartition(self.buckets, "bucket").mapInArrow(reply, ANSWERS)

    def finish(self, f: Callable, schema: str, answers: DataFrame) -> DataFrame:
        def last(key, table, said=None):
            out = f(table, said)
            release()
            return out

        return self._by_slice(last, answers, schema)

    def _by_slice(self, f, answers, schema):
        if answers is None:
            return self.docs.groupBy("in").applyInArrow(lambda key, table: f(key, table), schema)
        return self.docs.groupBy("in").cogroup(answers.groupBy("slice")).applyInArrow(lambda key, table, said: f(key, table, said), schema)


def packed(slice_: int, kind: int, names: np.ndarray, more: np.ndarray | None, buckets: int) -> list[dict]:
    b = ((names >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    b, names = b[order], names[order]
    more = None if more is None else more[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])
    return [{"bucket": int(b[x]), "slice": slice_, "kind": kind, "names": names[x:y].tobytes(), "more": None if more is None else more[x:y].tobytes()} for x, y in zip(lo, hi)] if len(b) else []


def told(said: pa.Table | None, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of a kind that were answered, sorted, and what more was said of each."""
    if said is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = [r for r in said.select(["kind", "names", "more"]).to_pylist() if r["kind"] == kind]
    names = np.frombuffer(b"".join(r["names"] for r in rows), np.uint64)
    more = np.frombuffer(b"".join(r["more"] or b"" for r in rows), np.uint64)
    order = np.argsort(names, kind="stable")
    return names[order], more[order] if len(more) else more


def once(names: np.ndarray) -> np.ndarray:
    """Distinct names; the lowest bit says whether one occurs more than once here."""
    u, n = np.unique(names | np.uint64(1), return_counts=True)
    return u ^ (n == 1).astype(np.uint64)


def groups(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the names, starts of the groups of equal ones in it, and the group of each sorted place."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def shared(kind, names, who, more):
    """Says every name (lowest bit set) that occurs more than once in all."""
    order, start, group = groups(names | np.uint64(1))
    flag = (names[order] & np.uint64(1)).astype(np.int64)
    n = np.diff(np.append(start, len(order)))
    many = ((n > 1) | (np.add.reduceat(flag, start) > 0 if len(start) else np.zeros(0, bool)))[group]
    at = order[many]
    return at, names[at] | np.uint64(1), None
