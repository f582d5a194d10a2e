"""Repeated byte strings by refining buckets of suffixes, over the whole corpus.

Bucket-pointer refinement: suffixes start in buckets of equal Q-grams; each level
sorts the members of a bucket, drops buckets with one member, and splits the
others by the identifiers of the buckets at other offsets, until a bucket stands
for whole strings of LENGTH bytes. A new identifier is made of the parent's
(itself refined by the levels before) and of the Q-gram buckets at an earlier and
at a later offset.

Two things keep what is sorted small. The first buckets hold only suffixes at
*anchors*: of every SPAN consecutive positions the one with the least Q-bucket
(leftmost on ties). A window of LENGTH bytes holds exactly SPAN Q-grams, so equal
windows have their anchor at the same place. And the windows of one anchor (a
*run* of consecutive starts) are one member as long as they can be: at each level
a bucket's members are compared as whole strings, equal ones are settled at once,
and only where a bucket holds unlike strings do its members go on, split by the
distance of their starts to the anchor (WIDTHS starts a member). Starts whose
distances lie in the same slot share more bytes than the parent did, from before
the parent's to after them; these are what the refined bucket is of. At the last
level a member is one window.

Defined cases: null text is empty; fewer than 200 bytes lose nothing; repeated
rows and repeats in one document count as other places; other columns are
ignored. Bytes are removed, so what remains may hold broken characters: the
digest is of the bytes, a text has U+FFFD in their place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.flat import U, lengths_of, mix, pair, texts_of
from papyra.llm.rows import text_struct
from papyra.llm.slices import Sliced, told

LENGTH = 200
Q = 101
SPAN = LENGTH - Q + 1
BLOCK = 1 << 15
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Suffixes:
    def __init__(self, table: pa.Table):
        self.data, self.off = texts_of(table.column("text"))
        n, size = len(self.data), np.diff(self.off)
        self.lo = self.hi = self.at = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        long = size >= LENGTH
        if not long.any():
            return
        m = n - LENGTH + 1
        raw = self.data.tobytes() + bytes(8)
        self.grams = np.empty(n - Q + 1, np.uint64)  # the bucket of the Q bytes from each position
        anchor = np.empty(m, np.int64)
        for a in range(0, m, BLOCK):  # blocks that fit the processor's cache
            b = min(a + BLOCK, m)
            names = mix(np.ndarray((b - a + LENGTH - 8,), np.uint64, raw, offset=a, strides=(1,)).copy())
            have = 8
            for length in (16, 32, 64, Q):
                by = length - have
                names = pair(names[: len(names) - by], names[by:])
                have = length
            self.grams[a : b + SPAN - 1] = names
            least = names >> U(32) << U(32)
            least |= np.arange(a, a + len(names), dtype=np.uint64)
            have = 1
            for width in (2, 4, 8, 16, 32, 64, SPAN):
                by = width - have
                least = np.minimum(least[: len(least) - by], least[by:])
                have = width
            anchor[a:b] = least & U(0xFFFFFFFF)
        edge = np.zeros(m + 1, np.int8)
        edge[self.off[:-1][long]] = 1
        edge[self.off[1:][long] - LENGTH + 1] -= 1
        start = np.flatnonzero(np.cumsum(edge[:m], dtype=np.int8))
        anchor = anchor[start]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)])
        first = np.flatnonzero(new)
        self.lo, self.at = start[first], anchor[first]
        self.hi = start[np.append(first[1:], len(start)) - 1]

    def windows(self, start: np.ndarray) -> np.ndarray:
        return pair(self.grams[start], self.grams[start + (LENGTH - Q)])


#: Starts per node at each level of refinement: a node is split into nodes of the next width.
WIDTHS = (SPAN, 20, 4, 1)
GONE, SETTLED, LEAD, MIXED = (U(k) for k in range(4))


class _Nodes:
    """Members of buckets at one level: starts lo..hi (of one run) whose distance to their anchor lies in one slot of the level."""

    def __init__(self, x: _Suffixes, level: int, lo, hi, at, slot, bucket):
        self.x, self.level, self.lo, self.hi, self.at, self.slot, self.bucket = x, level, lo, hi, at, slot, bucket

    @classmethod
    def first(cls, x: _Suffixes) -> _Nodes:
        """The initial buckets: equal Q-grams at the anchor, which all windows of the run hold."""
        return cls(x, 0, x.lo, x.hi, x.at, np.zeros(len(x.lo), np.int64), x.grams[x.at] if len(x.lo) else np.zeros(0, np.uint64))

    def whole(self) -> np.ndarray:
        """The name of each member's string, from its first start to LENGTH bytes after its last."""
        return pair(self.x.windows(self.lo), self.x.windows(self.hi) + (self.hi - self.lo).astype(np.uint64))

    def keys(self) -> np.ndarray:
        """What answers about a member are said of."""
        return pair(self.bucket, self.whole()) if len(self.lo) else self.bucket

    def pick(self, which: np.ndarray) -> _Nodes:
        return _Nodes(self.x, self.level, *(v[which] for v in (self.lo, self.hi, self.at, self.slot, self.bucket)))

    def refined(self) -> _Nodes:
        """The members of the next level, in buckets named by their parent's bucket and the buckets of an earlier and a later offset.

        The starts at distance t to the anchor, first <= t <= last, all hold the
        bytes from at - first to at - last + LENGTH: the Q-grams at both ends of
        these extend the parent's bytes to the left and to the right.
        """
        new = WIDTHS[self.level + 1]
        far, near = self.at - self.lo, self.at - self.hi
        slots = far // new - near // new + 1
        k = np.repeat(np.arange(len(self.lo)), slots)
        slot = near[k] // new + np.arange(len(k)) - np.repeat(np.cumsum(slots) - slots, slots)
        at = self.at[k]
        lo, hi = np.maximum(self.lo[k], at - (slot + 1) * new + 1), np.minimum(self.hi[k], at - slot * new)
        least, most = slot * new, np.minimum((slot + 1) * new, SPAN) - 1
        grams = pair(self.x.grams[at - least], self.x.grams[at - most + LENGTH - Q])
        bucket = pair(self.bucket[k], grams + slot.astype(np.uint64))
        return _Nodes(self.x, self.level + 1, lo, hi, at, slot, bucket)


def _ask_level(level: int):
    """Asks about the members that are still open after the levels before."""

    def ask(table, said):
        if level and not (told(said, level - 1)[1] >= LEAD).any():
            return
        nodes = _open(_Suffixes(table), said, level)[0]
        if len(nodes.lo):
            whole = nodes.whole() | U(1)
            _, first, n = np.unique(nodes.keys(), return_index=True, return_counts=True)
            yield level, nodes.bucket[first], whole[first] ^ (n == 1).astype(np.uint64)

    return ask


def _refine(kind, names, who, more):
    """Sorts the members of each bucket by their whole strings.

    A bucket with one member holds nothing repeated: it isn't answered and goes.
    Members whose whole string another one has are settled: all their windows
    repeat. Where a bucket holds several strings, it is refined further, with
    every lone string and, in the least slice that has it, one of each repeated.
    """
    whole = more | U(1)
    order = np.lexsort((who, whole, names))
    if not len(order):
        return order, names, None
    names, whole, who = names[order], whole[order], who[order]
    several = more[order] & U(1)
    new_bucket = np.concatenate([[True], names[1:] != names[:-1]])
    new = new_bucket | np.concatenate([[True], whole[1:] != whole[:-1]])
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    repeated = (np.diff(np.append(start, len(order))) > 1) | (np.maximum.reduceat(several, start) > 0)
    strings = np.bincount(np.cumsum(new_bucket)[start] - 1)[np.cumsum(new_bucket)[start] - 1]
    lead = np.zeros(len(order), bool)
    lead[start] = True
    mixed = (strings > 1)[group]
    state = np.where(repeated[group], np.where(mixed & lead, LEAD, SETTLED), np.where(mixed, MIXED, GONE))
    keep = state != GONE
    return order[keep], pair(names, whole)[keep], state[keep]


def _open(x: _Suffixes, said, level: int) -> tuple[_Nodes, list[_Nodes]]:
    """The members that a level sorts, and those that the levels before have settled."""
    nodes, settled = _Nodes.first(x), []
    for k in range(level):
        keys, state = told(said, k)
        mine = pair(nodes.bucket, nodes.whole() | U(1)) if len(nodes.lo) else nodes.bucket
        at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
        mine = np.where(keys[at] == mine, state[at], GONE) if len(keys) else np.full(len(mine), GONE)
        settled.append(nodes.pick((mine == SETTLED) | (mine == LEAD)))
        on = mine >= LEAD
        if k + 1 == len(WIDTHS):
            break
        # A string that stands several times in this slice goes on once.
        on[np.flatnonzero(on)] = _first_of(nodes.pick(on).keys())
        nodes = nodes.pick(on).refined()
    return nodes, settled


def _first_of(keys: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(keys), bool)
    mask[np.unique(keys, return_index=True)[1]] = True
    return mask


def _gone(x: _Suffixes, said) -> np.ndarray:
    """Mask of the bytes to remove: those of all windows of settled members."""
    if said is None or not len(said):
        return np.zeros(len(x.data), bool)
    d = np.zeros(len(x.data) + 1, np.int64)
    for nodes in _open(x, said, len(WIDTHS))[1]:
        np.add.at(d, nodes.lo, 1)
        np.add.at(d, nodes.hi + LENGTH, -1)
    return np.cumsum(d[:-1]) > 0


def _kept(x: _Suffixes, gone: np.ndarray, i: int) -> bytes:
    a, b = x.off[i], x.off[i + 1]
    return x.data[a:b][~gone[a:b]].tobytes()


def _digest(table, said):
    x = _Suffixes(table)
    gone = _gone(x, said)
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    edge = x.off[(x.off > 0) & (x.off < len(gone))]
    starts[edge] = gone[edge]
    return pa.table({
        "doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(x.off), pa.int64()), "n_removed": pa.array(lengths_of(gone, x.off), pa.int64()),
        "n_spans": pa.array(lengths_of(starts, x.off), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(_kept(x, gone, i)).hexdigest() for i in range(table.num_rows)], pa.string()),
    })


def _texts(names: list[str]):
    def run(table, said):
        x = _Suffixes(table)
        gone = _gone(x, said)
        cut = lengths_of(gone, x.off) > 0
        # A null text stays null.
        text = [_kept(x, gone, i).decode("utf-8", "replace") if c else t for i, (c, t) in enumerate(zip(cut, table.column("text").to_pylist()))]
        row = table.column("row").combine_chunks()
        row = row if isinstance(row, pa.StructArray) else pa.concat_arrays(row.chunks)
        columns = dict(zip((f.name for f in row.type), row.flatten())) | {"text": pa.array(text, pa.string())}
        if "n_chars" in names:
            columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(text, columns["n_chars"].to_pylist())], columns["n_chars"].type)
        return pa.table({"row": pa.StructArray.from_arrays([columns[c] for c in names], names)})

    return run


def _answered(c: Sliced) -> DataFrame:
    """One question and answer a level; each level asks by what all before it have answered."""
    said = c.answer(c.ask(_ask_level(0)), _refine)
    for level in range(1, len(WIDTHS)):
        said = said.union(c.answer(c.ask(_ask_level(level), said), _refine))
    return said


def suffix_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    c = Sliced(docs)
    return c.finish(_digest, RESULT, _answered(c))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes removed from their texts; n_chars, where there is one, follows."""
    c = Sliced(docs, carry=tuple(x for x in docs.columns if x != "text"))
    return c.finish(_texts(docs.columns), f"row {text_struct(docs)}", _answered(c)).select("row.*")
