"""Mixing: targets, permutations, shares, and texts that hold what was taken."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from papyra.llm.mixing import BLOCK, WORD, draw, mix_plan, mix_sources, mixed_documents, permuted, shard_slots, targets
from papyra.llm.rows import row_hash


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    t = targets([10, 500, 490], [5, 2, 1])
    assert t[0] == 30 and abs(sum(t) - 1000) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9
    assert targets([0, 0], [5, 2]) == [0, 0] and targets([], []) == []


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        for epoch in (0, 2):
            assert sorted(permuted(np.arange(n) + epoch * n, np.full(n, n), np.zeros(n, int)).tolist()) == list(range(n))
    assert (permuted(np.arange(100), np.full(100, 100), np.zeros(100, int)) != permuted(np.arange(100) + 100, np.full(100, 100), np.zeros(100, int))).any()


def test_draws_come_near_the_need_and_keep_the_most():
    need, most = np.array([1000.0, 10, 0, 333]), np.array([1000, 10, 50, 999])
    d = draw(need, most, 60, np.random.default_rng(0))
    assert d.sum() == 1343 and (d.sum(1)[:-1] == 60).all() and (d.sum(0) <= most).all()
    assert (abs(d.sum(0) - need) <= 12).all()
    other = draw(need, 2 * most, 60, np.random.default_rng(1))
    assert (other[:5] != d[:5]).any() and other[:-1].std(0)[0] > 1
    assert draw(np.array([50.0]), np.array([20]), 7, np.random.default_rng(0)).sum() == 20


def mixed(rows, hashes, seed):
    """The mix in plain Python: (doc_id, source, size, taken) of each row, and (shard, source, block, turn) of each slot."""
    size = [len(re.findall(WORD, t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = [sum(n for n, r in zip(size, rows) if r[2] == s) for s in names]
    goal = targets(own, [(5, 2, 1)[i % 3] for i in range(len(names))])
    live = [i for i in range(len(names)) if goal[i] > 0]
    blocks = {i: -(-own[i] // BLOCK) for i in live}
    need = np.array([goal[i] * blocks[i] / own[i] for i in live])
    counts = draw(need, 3 * np.array([blocks[i] for i in live]), shard_slots(round(need.sum())), np.random.default_rng(seed))
    slots, seen = [], Counter()
    for shard, held in enumerate(counts):
        for i, n in zip(live, held):
            for _ in range(n):
                r, seen[i] = seen[i], seen[i] + 1
                slots.append((shard, names[i], int(permuted(np.array([r]), np.array([blocks[i]]), np.array([i]), seed)[0]), r // blocks[i]))
    uses = Counter((s, b) for _, s, b, _ in slots)
    parts, out = int(np.sqrt(len(rows))), []
    for s in names:
        at = 0
        for k in sorted((k for k in range(len(rows)) if rows[k][2] == s), key=lambda k: (hashes[k] % parts, hashes[k])):
            out.append((rows[k][0], s, size[k], sum(uses[s, w // BLOCK] for w in range(at, at + size[k]))))
            at += size[k]
    return out, slots


def test_against_plain_python(make):
    """Rows without repeats; another seed gives another mix."""
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i * 37 % 400)), [None, "a", "b", "c"][i * i % 7 % 4]) for i in range(90)] + [(90, None, "a"), (91, " ", "d")]
    docs = make(rows)
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", row_hash(docs).alias("h")).collect()}
    results = []
    for seed in (1, 2):
        taken, slots = mixed(rows, [h[r[0]] for r in rows], seed)
        got = [(r["doc_id"], r["source"], r["size"], r["taken"]) for r in mix_sources(docs, seed).collect()]
        assert sorted(got, key=str) == sorted(taken, key=str)
        plan = mix_plan(docs, seed).collect()
        assert Counter((r["shard"], r["source"], r["block"], r["turn"]) for r in plan) == Counter(slots)
        for shard in {r["shard"] for r in plan}:
            own = sorted(r["slot"] for r in plan if r["shard"] == shard)
            assert own == list(range(len(own)))
        results.append(sorted(got, key=str))
    assert results[0] != results[1]


def test_blocks_are_numbered_once(docs):
    """A null check of the join was pushed below the numbering, which then ran twice, each time in workers of its own."""
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert steps(mix_sources(docs)) == 1
    assert steps(mixed_documents(docs)) == 2  # the other one writes the texts


def test_texts_are_dealt_once(spark):
    """Ids as a second key of the join dealt all texts out again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, lines = [], plan.split("\n")
    k = next(i for i, x in enumerate(lines) if "FileScan" in x and "text" in x)
    for x in reversed(lines[: k + 1]):
        depth = len(x) - len(x.lstrip(" :+-*"))
        if not above or depth < above[-1][0]:
            above.append((depth, x))
    assert sum("Exchange hashpartitioning" in x for _, x in above) == 1


def test_names_may_clash(docs):
    other = docs
    for c in ("_h", "_p", "_d", "_all", "sid", "at", "size", "row", "its", "all", "part", "taken"):
        other = other.withColumn(c, F.lit("x"))
    assert Counter(map(tuple, mix_sources(other).select("doc_id", "size", "target").collect())) == Counter(map(tuple, mix_sources(docs).select("doc_id", "size", "target").collect()))
    out = mixed_documents(other)
    assert out.columns == other.columns and {r[c] for r in out.collect() for c in ("_h", "_p", "sid", "row", "taken")} == {"x"}


def test_shares(docs, rows):
    got = mix_sources(docs).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_sources(docs).collect()))
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 64 + 0.05 * own[0]["target"]


def test_corpus_shares(spark):
    got = mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.02 for r in got)


def test_texts_hold_what_was_taken(docs):
    taken = Counter((r["doc_id"], r["taken"]) for r in mix_sources(docs).collect() if r["taken"])
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r["doc_id"], len(re.findall(WORD, r["text"]))) for r in got) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_empty(nothing, docs):
    assert mix_sources(nothing).collect() == [] and mixed_documents(nothing).collect() == []
    blank = docs.where("doc_id in (1, 2, 3)")
    assert {(r["size"], r["target"], r["taken"]) for r in mix_sources(blank).collect()} == {(0, 0.0, 0)}
