"""Near-copies by DartMinHash signatures, banded joins and exact verification.

A text is the set of its five-word shingles (all words as one shingle if there
are fewer), or, with counts=True, the multiset. For each element a Poisson
process of darts, fixed by hashes, falls on the plane of weight x rank; a text
gets the darts below its elements' weights. Every dart belongs to one of
BANDS x ROWS coordinates, whose signature value is the dart of least rank. As
many ranks are looked at as give each coordinate a dart on average 4 + ln times
over, so a text costs its own length plus the signature's, not their product;
a text that leaves a coordinate empty looks at twice the ranks.

Equal sets are one node from then on. Texts that agree on a band meet in a
bucket: up to `SMALL` nodes in all pairs, larger ones with the least and the
greatest node. These candidate pairs are verified on the whole sets, unless
sketches of 64 coordinates (a byte each) agree in so few that this happens to one
in 10^6 pairs of that similarity. Large buckets that then still hold several
groups are compared whole, without sketches: all pairs of different groups, in
blocks of `BLOCK` by `BLOCK` nodes. Two texts of similarity 0.8 share no bucket
with probability (1 - 0.8^5)^32 < 4e-6.

Defined cases: texts without words (null, empty, blank) are a class of their own
each; repeated rows are copies; a null doc_id counts as larger than any other and
the class of null ids alone is null; other columns, whatever their names, are
ignored, or kept where documents are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.flat import ODD, U, chains, mix, pair, release, texts_of, word_names, words_of
from papyra.llm.rows import whole
from papyra.operators.components import connected_components, least_labels
from papyra.plans.durable import checkpointed, one_worker_pool

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SMALL = 8
#: Nodes, and bytes of their sets, on each side of a block of pairs; names whose products are added in one go.
BLOCK, BLOCK_BYTES, SLAB = 1024, 4 << 20, 2048
#: Documents whose darts are thrown together, and cells of the plane looked at in one go.
TOGETHER, CELLS = 256, 1 << 19
_poisson = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of each text, their counts, and where each text's begin (n+1)."""
    data, off = texts_of(column)
    s, e, first = words_of(data, off)
    words = word_names(data, s, e)
    runs = chains(words, (2, 4, SHINGLE))
    sets, counts = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            u, n = np.unique(runs[a : b - SHINGLE + 1], return_counts=True)
        else:
            u = words[a:b]
            while len(u) > 1:
                u = np.concatenate([pair(u[:1], u[1:2]), u[2:]])
            n = np.ones(len(u), np.int64)
        sets.append(u)
        counts.append(n)
    at = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int64)
    join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return join(sets, np.uint64), join(counts, np.int64), at


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def signatures(names: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signature [text, coordinate] of each text; its elements are names[at[i]:at[i + 1]]."""
    n = len(at) - 1
    out = np.full((n, COORDINATES), np.iinfo(np.uint64).max, np.uint64)
    # Weight cells of an element: [0, 1), [1, 2), [2, 4), [4, 8) ... up to its weight.
    levels = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(names)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    wide = np.maximum(low, 1.0)
    text = np.repeat(np.arange(n), np.diff(at))[element]
    cell = mix(names[element] + level.astype(np.uint64) * ODD)
    total = np.bincount(text, wide, n)
    bound = np.ceil(COORDINATES * (np.log(COORDINATES) + 4) / np.maximum(total, 1)).astype(np.int64)
    done = np.zeros(n, np.int64)
    todo = total > 0
    while todo.any():
        ranks = np.where(todo, bound - done, 0)[text]
        cuts = np.searchsorted(np.cumsum(ranks), np.arange(0, int(ranks.sum()) + CELLS, CELLS))
        for a, b in zip(cuts[:-1].tolist(), np.append(cuts[1:-1], len(ranks)).tolist()):
            if a < b:
                _throw(out, cell[a:b], low[a:b], wide[a:b], weights[element[a:b]], text[a:b], done[text[a:b]], ranks[a:b])
        done = np.where(todo, bound, done)
        bound = np.where(todo, bound * 2, bound)
        todo = todo & (out == np.iinfo(np.uint64).max).any(1)
    return out


def _throw(out, cell, low, wide, weight, text, done, ranks):
    """Darts of the cells, each over its ranks from done on; a cell wider than 1 is wide unit cells."""
    units = ranks * wide.astype(np.int64)
    k = np.repeat(np.arange(len(cell)), units)
    place = np.arange(len(k)) - np.repeat(np.cumsum(units) - units, units)
    w = wide[k].astype(np.int64)
    rank, across = done[k] + place // w, place % w
    h = mix(cell[k] + (rank * 0x100000 + across).astype(np.uint64) * ODD)
    darts = np.searchsorted(_poisson, _unit(h))
    k2 = np.repeat(np.arange(len(k)), darts)
    nth = np.arange(len(k2)) - np.repeat(np.cumsum(darts) - darts, darts)
    d = mix(h[k2] + (nth + 1).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    c = k[k2]
    under = low[c] + across[k2] + _unit(mix(d + U(1))) < weight[c]
    d, c, rank = d[under], c[under], rank[k2[under]]
    coordinate = (d % U(COORDINATES)).astype(np.int64)
    exact = ((rank + _unit(mix(d + U(2)))) * 2.0**20).astype(np.uint64)
    np.minimum.at(out.reshape(-1), text[c] * COORDINATES + coordinate, exact << U(20) | d >> U(44))


def _signed(counts: bool):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                part = b.slice(a, TOGETHER)
                names, weights, at = shingle_sets(part.column(2))
                if not counts:
                    weights = np.ones_like(weights)
                n = np.diff(at)
                sig = signatures(names, weights.astype(np.float64), at).reshape(len(n), BANDS, ROWS)
                key = sig[:, :, 0] + np.arange(BANDS, dtype=np.uint64) * ODD
                for r in range(1, ROWS):
                    key = pair(key, sig[:, :, r])
                whole = np.concatenate([[U(0)], np.cumsum(mix(names + weights.astype(np.uint64)), dtype=np.uint64)])
                node = mix(whole[at[1:]] - whole[at[:-1]] + n.astype(np.uint64)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(key.reshape(-1).view(np.int64)))
                low = (sig[:, :, :2].reshape(len(n), 64) & U(255)).astype(np.uint8).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 8), pa.array(low.reshape(-1)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(node, mask=n == 0), bands, sketch], names=["doc_id", "h", "node", "bands", "sketch"])
            release()

    return run


def _set_rows(counts: bool):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                part = b.slice(a, TOGETHER)
                names, weights, at = shingle_sets(part.column(1))
                short = (names >> U(32)).astype(np.uint32)
                packed = [(short[x:y].tobytes(), weights[x:y].astype(np.uint32).tobytes() if counts else b"") for x, y in zip(at[:-1], at[1:])]
                yield pa.record_batch([part.column(0), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["node", "names", "weights"])
            release()

    return run


def similarity(x: bytes, y: bytes, u: bytes = b"", v: bytes = b"") -> float:
    """Jaccard similarity of two packed sets, weighted if they have weights."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    p = np.frombuffer(u, np.uint32).astype(np.int64) if u else np.ones(len(a), np.int64)
    q = np.frombuffer(v, np.uint32).astype(np.int64) if v else np.ones(len(b), np.int64)
    k = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    same = b[k] == a if len(b) else np.zeros(len(a), bool)
    both = int(np.minimum(p[same], q[k[same]]).sum())
    return both / max(1, int(p.sum()) + int(q.sum()) - both)


def _verify(similar: float):
    def run(batches):
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            keep = np.array([similarity(*x) >= similar for x in zip(c["xn"], c["yn"], c["xw"], c["yw"])], bool)
            yield pa.record_batch([pa.array(np.array(c[n], np.int64)[keep]) for n in ("a", "b")], names=["a", "b"])
            release()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    side = lambda p, n: sets.select(F.col("node").alias(n), F.col("names").alias(p + "n"), F.col("weights").alias(p + "w"))
    size = sets.select(F.col("node").alias("b"), F.octet_length("names").alias("size"))
    # Sizes alone rule out most pairs that can't reach the similarity, before a second set is sent to them.
    small, large = F.least("size", F.octet_length("xn")), F.greatest("size", F.octet_length("xn"))
    fits = (small >= similar * large) | (F.octet_length("xw") > 0)
    both = pairs.join(size, "b").join(side("x", "a"), "a").where(fits).join(side("y", "b"), "b")
    return both.select("a", "b", "xn", "yn", "xw", "yw").mapInArrow(_verify(similar), "a long, b long")


def _agree(a: str, b: str):
    """In how many of 64 coordinates two sketches (eight bytes in each of eight longs) agree."""
    unlike = F.lit(0)
    for k in range(8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for by in (4, 2, 1):  # the lowest bit of a byte becomes whether any of its bits is set
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return 64 - unlike


def least_agreement(similar: float) -> int:
    """Coordinates of 64 in which sketches of that similarity agree but for one in 10^6."""
    return max(0, int(64 * similar - 4.75 * np.sqrt(64 * similar * (1 - similar))))


def _met(placed: DataFrame, leads: list, agree: int) -> DataFrame:
    """Pairs (a, b) of the nodes of each bucket with its leads, where groups differ and sketches agree."""
    row = F.struct("node", "group", "sketch")
    chosen = placed.groupBy("band").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.array_distinct(F.array(*(F.min_by(row, o) for o in leads))).alias("leads"))
    lead = chosen.where("g0 != g1").select("band", F.explode("leads").alias("l")).select("band", F.col("l.node").alias("_n"), F.col("l.group").alias("_g"), F.col("l.sketch").alias("_s"))
    both = placed.join(lead.hint("merge"), "band").where(F.col("group") != F.col("_g")).where(_agree("sketch", "_s") >= agree)
    return both.select(F.least("node", "_n").alias("a"), F.greatest("node", "_n").alias("b"))


def _elements(names: bytes, weights: bytes) -> np.ndarray:
    """A packed set as distinct 64-bit elements: a name of weight w, or one that stands w times, is w of them."""
    a = np.frombuffer(names, np.uint32)
    if weights:
        a = np.repeat(a, np.frombuffer(weights, np.uint32).astype(np.int64))
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return a.astype(np.uint64) << U(32) | nth.astype(np.uint64)


def in_both(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of xs has in common with each of ys."""
    x, y = (np.concatenate([np.zeros(0, np.uint64), *s]) for s in (xs, ys))
    names = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if len(names) == 0:
        return out

    def placed(sets, all_):
        k = np.minimum(np.searchsorted(names, all_), len(names) - 1)
        at = np.flatnonzero(names[k] == all_)
        at = at[np.argsort(k[at], kind="stable")]
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[at], k[at]

    (row, i), (column, j) = placed(xs, x), placed(ys, y)
    n, m = np.bincount(i, minlength=len(names)), np.bincount(j, minlength=len(names))
    # Names that few hold are counted pair by pair, the others by products of 0-1 matrices.
    rare = n * m * 256 <= out.size
    start = np.cumsum(m) - m
    few = np.flatnonzero(rare[i])
    pairs = np.cumsum(m[i[few]])
    cuts = np.searchsorted(pairs, np.arange(0, int(pairs[-1]) + CELLS, CELLS)) if len(few) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), np.append(cuts[1:-1], len(few)).tolist()):
        e = few[a:b]
        times = m[i[e]]
        other = np.repeat(start[i[e]] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        out += np.bincount(np.repeat(row[e], times) * len(ys) + column[other], minlength=out.size).reshape(out.shape)
    kept = np.cumsum(~rare) - 1
    keep, keep_too = ~rare[i], ~rare[j]
    row, i, column, j = row[keep], kept[i[keep]], column[keep_too], kept[j[keep_too]]
    for a in range(0, int((~rare).sum()), SLAB):
        left, right = np.zeros((len(xs), SLAB), np.float32), np.zeros((len(ys), SLAB), np.float32)
        u, v = slice(*np.searchsorted(i, [a, a + SLAB])), slice(*np.searchsorted(j, [a, a + SLAB]))
        left[row[u], i[u] - a] = 1
        right[column[v], j[v] - a] = 1
        out += left @ right.T
    return out


def _joined(similar: float):
    """Links (a, b) that join the groups of a block: all pairs of its two sides (or of its one side) are compared."""

    def run(key, table):
        part = table.column("part").to_numpy()
        ids, group = np.unique(table.column("group").to_numpy(), return_inverse=True)
        sets = [_elements(n, w) for n, w in zip(table.column("names").to_pylist(), table.column("weights").to_pylist())]
        size = np.array([len(s) for s in sets], np.float64)
        x, y = (np.flatnonzero(part == k.as_py()) for k in key[1:])
        both = in_both([sets[k] for k in x], [sets[k] for k in y]).astype(np.float64)
        union = size[x][:, None] + size[y][None, :] - both
        i, j = np.nonzero((both / np.maximum(union, 1) >= similar) & (group[x][:, None] != group[y][None, :]))
        label = least_labels(group[x[i]], group[y[j]], len(ids))
        release()
        return pa.table({"a": ids, "b": ids[label]}).filter(pa.array(label != np.arange(len(ids))))

    return run


def _rest(many: DataFrame, groups: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links between the groups (named by nodes) of large buckets: every pair of different groups of a bucket is compared.

    The largest group of a bucket is compared with the others, not with itself, and
    the others with each other. Both are dealt into parts by a hash of the node; a
    pair of parts is a block, and a task holds one block.
    """
    placed = many.join(groups, "node", "left").select("band", "node", F.coalesce("component", "node").alias("group"))
    sized = placed.join(sets.select("node", F.octet_length("names").cast("long").alias("size")), "node")
    row = F.struct("n", "size", "group")
    held = sized.groupBy("band", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    held = held.groupBy("band").agg(F.max(row).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    held = held.select("band", F.col("main.group").alias("_m"), parts(F.col("main.n"), F.col("main.size")).alias("_p"), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("_q"))
    main, salt = F.col("group") == F.col("_m"), F.xxhash64("node", F.lit(1))
    dealt = placed.join(held.hint("merge"), "band").withColumn("part", F.when(main, F.pmod(salt, "_p")).otherwise(F.col("_p") + F.pmod(salt, "_q")).cast("int"))
    dealt = dealt.select("band", "node", "group", "part", F.when(main, F.col("_p")).otherwise(0).alias("_from"), (F.col("_p") + F.col("_q") - 1).alias("_to"))
    full = dealt.join(sets, "node").select("band", "group", "part", "names", "weights", F.explode(F.sequence("_from", "_to")).alias("_k"))
    blocks = full.select("band", F.least("part", "_k").alias("x"), F.greatest("part", "_k").alias("y"), "part", "group", "names", "weights")
    return blocks.groupBy("band", "x", "y").applyInArrow(_joined(similar), "a long, b long").distinct()


def near_copies(docs: DataFrame, similar: float = SIMILAR, counts: bool = False) -> DataFrame:
    """Per row: doc_id, h (hash of id and text), class_id (least doc_id of its class), kept (it is that document, once)."""
    one_worker_pool(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
    signed = checkpointed(keyed.mapInArrow(_signed(counts), "doc_id long, h long, node long, bands array<long>, sketch array<long>"))
    nodes, agree = signed.where("node is not null"), least_agreement(similar)
    places = nodes.dropDuplicates(["node"]).select("node", "sketch", F.explode("bands").alias("band"))
    sizes = nodes.select("node", "bands").dropDuplicates(["node"]).select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(places.join(sizes, "band"))
    few, many = shared.where(F.col("n") <= SMALL).select("band", "node", "sketch"), shared.where(F.col("n") > SMALL).select("band", "node", "sketch")
    other = few.select("band", F.col("node").alias("b"), F.col("sketch").alias("_s"))
    pairs = few.withColumnRenamed("node", "a").join(other, "band").where("a < b").where(_agree("sketch", "_s") >= agree).select("a", "b")
    pairs = pairs.union(_met(many.withColumn("group", F.col("node")), [F.col("node"), -F.col("node").cast("double")], agree))
    pairs = checkpointed(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands")))
    # The text of one row of each node that is in a pair.
    wanted = nodes.select("node", "h").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("h").alias("h"))
    sets = checkpointed(wanted.join(keyed, "h").select("node", "text").mapInArrow(_set_rows(counts), "node long, names binary, weights binary").dropDuplicates(["node"]))
    # First each node with the partner it shares most bands with; then only pairs that could still join two groups.
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "bands")
    best = ends.groupBy("p.x").agg(F.max(F.struct("bands", "p.y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    links = checkpointed(_verified(best, sets, similar))
    groups = checkpointed(connected_components(links))
    side = lambda n, g: groups.select(F.col("node").alias(n), F.col("component").alias(g))
    apart = pairs.join(side("a", "ga"), "a", "left").join(side("b", "gb"), "b", "left").where("ga is null or gb is null or ga != gb").select("a", "b")
    found = checkpointed(_verified(apart.join(best, ["a", "b"], "left_anti"), sets, similar))
    if not found.isEmpty():
        links = links.union(found)
        groups = checkpointed(connected_components(links))
    found = checkpointed(_rest(many, groups, sets, similar))
    if not found.isEmpty():
        links = links.union(found)
        groups = checkpointed(connected_components(links))
    labelled = signed.select("doc_id", "h", "node").join(groups.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("first"))
    return labelled.join(least, "label", "left").select("doc_id", "h", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.col("label").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))).alias("kept"))


def without_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, the least doc_id, with all columns."""
    kept = near_copies(docs, similar).where("kept").select("h", F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"), whole(docs)).repartition("h")
    both = rows.withColumn("own", F.col("row.doc_id").cast("long")).join(kept, "h").where(F.col("own").eqNullSafe(F.col("id")))
    return both.dropDuplicates(["h", "own"]).select("row.*")
