"""Exact repeats of word windows, found by anchors on a difference cover.

A window is `WINDOW` (13) consecutive words. {0, 1, 3} is a difference cover
modulo 7: for any two positions i and j there is a shift d < 7 with (i + d) mod 7
and (j + d) mod 7 both in the cover. So only the 7-word anchors at cover
positions are named (3 in 7); two equal windows of 13 = 7 + 6 words share an
aligned equal anchor wholly inside them. Anchors that occur once in the corpus
settle nothing more; those that repeat are extended to the windows around them,
and the smallest document of each such window decides.

Defined cases: null or blank text has no words; a document with fewer than 13
words loses nothing; a null doc_id is larger than all others; repeated rows with
one doc_id don't remove each other's words; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.flat import chains, covered, lengths_of, member, texts_of, word_names, words_of
from papyra.llm.slices import Sliced, groups, once, shared, told

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
U = np.uint64
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


class _Words:
    """Words of a slice with the names of their runs."""

    def __init__(self, table: pa.Table):
        self.ids = np.array([LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.data, self.off = texts_of(table.column("text"))
        self.s, self.e, self.first = words_of(self.data, self.off)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.names = word_names(self.data, self.s, self.e)
        self.left = self.first[1:][self.doc] - np.arange(len(self.s))  # words from here to the document's end
        self.local = np.arange(len(self.s)) - self.first[:-1][self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        a = chains(self.names, (2, 4, PERIOD))
        at = np.flatnonzero(np.isin(self.local[: len(a)] % PERIOD, COVER) & (self.left[: len(a)] >= PERIOD))
        return at, a[at]

    def windows(self) -> np.ndarray:
        return chains(self.names, (2, 4, PERIOD, WINDOW))

    def near(self, hits: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor at one of the hits."""
        mask, floor = np.zeros(len(self.s), bool), self.first[:-1][self.doc[hits]]
        for d in range(WINDOW - PERIOD + 1):
            mask[np.maximum(hits - d, floor)] = True
        return np.flatnonzero(mask & (self.left >= WINDOW))


def _ask_anchors(table, said):
    yield 0, once(_Words(table).anchors()[1]), None


def _ask_windows(table, said):
    w = _Words(table)
    at, names = w.anchors()
    start = w.near(at[member(names | U(1), told(said, 0)[0])])
    if len(start):
        names, least = _least(w.windows()[start], w.ids[w.doc[start]])
        yield 1, names, least.view(np.uint64)


def _least(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, start, _ = groups(names)
    return names[order[start]], np.minimum.reduceat(ids[order], start) if len(start) else ids[:0]


def _first(kind, names, who, more):
    """Says the smallest document of each window to the slices whose own smallest is larger."""
    order, start, group = groups(names)
    own = more.view(np.int64)[order]
    least = np.minimum.reduceat(own, start)[group] if len(start) else own
    later = least < own
    at = order[later]
    return at, names[at], least[later].view(np.uint64)


def _cut(table, said):
    w = _Words(table)
    names = w.windows()
    start = np.flatnonzero(w.left[: len(names)] >= WINDOW)
    names, ids = names[start], w.ids[w.doc[start]]
    order, first, group = groups(names)
    least = np.empty(len(names), np.int64)
    if len(first):
        least[order] = np.minimum.reduceat(ids[order], first)[group]
    there, smallest = told(said, 1)
    if len(there):
        k = np.minimum(np.searchsorted(there, names), len(there) - 1)
        least = np.where(there[k] == names, np.minimum(least, smallest.view(np.int64)[k]), least)
    gone = covered(len(w.s), start[least < ids], WINDOW)
    raw = w.data.tobytes()
    out = []
    removed = lengths_of(gone, w.first)
    for i, doc in enumerate(table.column("doc_id").to_pylist()):
        a, b = w.first[i], w.first[i + 1]
        kept = b" ".join(raw[x:y] for x, y in zip(w.s[a:b][~gone[a:b]].tolist(), w.e[a:b][~gone[a:b]].tolist()))
        out.append((doc, int(b - a), int(removed[i]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    return pa.table({c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate((("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())))})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the kept words as text."""
    c = Sliced(docs)
    repeated = c.answer(c.ask(_ask_anchors), shared)
    return c.finish(_cut, RESULT, c.answer(c.ask(_ask_windows, repeated), _first))
