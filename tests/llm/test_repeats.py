"""Word windows and byte strings that repeat, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyra.llm import slices
from papyra.llm.substrings import COVER, PERIOD, WINDOW, substring_dedup
from papyra.llm.suffixes import LENGTH, suffix_digests, without_repeats


@pytest.fixture(autouse=True, params=[(2 << 20, 16 << 20), (4000, 6000)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_BYTES", request.param[0])
    monkeypatch.setattr(slices, "BUCKET_BYTES", request.param[1])


def test_cover_shares_an_anchor():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(WINDOW - PERIOD + 1))


def brute_words(rows):
    big = float("inf")
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t, _ in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - WINDOW + 1):
            k = tuple(w[i : i + WINDOW])
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i : i + WINDOW])] < (big if d is None else d):
                gone[i : i + WINDOW] = [True] * WINDOW
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def brute_bytes(rows):
    texts = [(d, (t or "").encode()) for d, t, _ in rows]
    count = Counter(t[i : i + LENGTH] for _, t in texts for i in range(len(t) - LENGTH + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if count[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_words(docs, rows):
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_words(rows), key=key)


def test_bytes(docs, rows):
    got = suffix_digests(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_bytes(rows), key=key)


def test_stage_keeps_columns(docs, rows):
    out = without_repeats(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"], r["slice"], r["n_chars"]) for r in out.collect()}
    assert (4, "one two three", "x", 13) in got and (2, None, "x", None) in got and (12, "", "x", 0) in got and len(out.collect()) == len(rows)


def knots():
    """Texts that share a core in unlike surroundings, so that buckets have to be refined level by level."""
    r = random.Random(5)
    core = "".join(r.choice("abcdefgh") for _ in range(330))
    rows = []
    for k in range(60):
        cut, to = r.randrange(0, 130), r.randrange(200, 331)
        rows.append((k, "".join(r.choice("xyz") for _ in range(r.randrange(0, 60))) + core[cut:to] + "".join(r.choice("uvw") for _ in range(r.randrange(0, 60))), "a"))
    return rows + [(100, core, "a"), (101, core, "a"), (102, core[:199], "a"), (103, core[65:264] + "é" + core[66:270], "a"), (104, "q" + core[100:300], "a"), (105, "r" + core[100:300], "a")]


def test_refinement(make):
    rows = knots()
    want = brute_bytes(rows)
    assert len({w[2] for w in want}) > 20
    got = suffix_digests(make(rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_names_may_clash(docs):
    other = docs.withColumn("_slice", F.lit("x")).withColumn("in", F.lit("y")).withColumn("a.b `c", F.lit("z"))
    out = without_repeats(other)
    assert out.columns == other.columns
    assert {(r["_slice"], r["in"], r["a.b `c"]) for r in out.collect()} == {("x", "y", "z")}


def test_empty(nothing):
    assert substring_dedup(nothing).collect() == [] and suffix_digests(nothing).collect() == [] and without_repeats(nothing).collect() == []
