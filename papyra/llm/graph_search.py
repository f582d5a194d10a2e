"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Distinct vectors are dealt over shards of about SHARD vectors by a hash. In each
shard a graph is built in numpy: nodes are inserted in batches; a greedy beam
search from the medoid proposes each node's neighbours, and robust pruning keeps
the nearest one, drops all that are nearer to it (by ALPHA) than to the node, and
so on, so edges point in diverse directions; back edges are pruned the same way.
A graph is stored with its shard, and packs of queries are sent to every shard and
searched there with a beam of BEAM; searches of a pack advance together, by
EXPANDED nodes of each beam a step. The scores of what a shard finds are exact
cosines in double precision.

Equal vectors are one node with its smallest ids (as many as a result can hold),
so ties between copies go to the smallest ids. Cosine is what is searched.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of another dimension than the query;
repeated rows with one vec_id count as one, asked by the vector of least hash; a null vec_id takes no part; fewer candidates than k give
all of them; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.flat import release
from papyra.llm.vectors import cosines, rows_of, unit, usable
from papyra.plans.durable import checkpointed

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 50_000, 32, 64, 96, 1.2
#: Queries searched together, and packs of them that one copy of a shard serves.
QUERIES, PACKS = 512, 64
#: Nodes that a search expands in one step, and candidates that pruning looks at.
EXPANDED, PROPOSED = 4, 64
BATCH = 256
SLACK = 16
_schema = "query_id long, vec_id long, score double"


class Graph:
    """Neighbours [node, DEGREE] (-1: none) of unit vectors, and where searches begin."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.entry = int(np.argmax(self.x @ self.x.mean(0))) if n else 0
        self.edges = np.full((n, DEGREE), -1, np.int32) if edges is None else edges

    def build(self, seed: int = 3) -> Graph:
        n, r = len(self.x), np.random.default_rng(seed)
        if n <= DEGREE + 1:
            for i in range(n):
                self.edges[i, : n - 1] = np.delete(np.arange(n), i)
            return self
        # While the graph grows, nodes may have SLACK edges more, so that few back edges make a node be pruned.
        self.edges = np.full((n, DEGREE + SLACK), -1, np.int32)
        self.edges[:, : DEGREE // 2] = (np.arange(n)[:, None] + r.integers(1, n, (n, DEGREE // 2))) % n
        order = r.permutation(n)
        for a in range(0, n, BATCH):
            self._insert(order[a : a + BATCH])
        self.edges = np.concatenate([self._pruned(part, self.edges[part]) for part in np.split(np.arange(n), range(BATCH, n, BATCH))])
        return self

    def _insert(self, new: np.ndarray) -> None:
        found, _ = self.search(self.x[new], BUILD_BEAM)
        self.edges[new] = -1
        self.edges[new, :DEGREE] = self._pruned(new, np.concatenate([found, self.edges[new]], 1))
        # Back edges: appended where there is room, pruned where there isn't.
        src, dst = np.repeat(new, DEGREE), self.edges[new, :DEGREE].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        count = np.diff(np.append(first, len(dst)))
        to, place = dst[first], np.arange(len(dst)) - np.repeat(first, count)
        own = self.edges[to]
        own.sort(1)
        own = own[:, ::-1]
        room = (own < 0).sum(1)
        fits = count <= room
        put = np.repeat(fits, count)
        own[np.repeat(np.arange(len(to)), count)[put], (np.repeat(own.shape[1] - room, count) + place)[put]] = src[put]
        self.edges[to[fits]] = own[fits]
        for a in range(0, int((~fits).sum()), BATCH):
            full = np.flatnonzero(~fits)[a : a + BATCH]
            extra = np.full((len(full), int(count[full].max())), -1, np.int64)
            k = np.arange(int(count[full].sum())) - np.repeat(np.cumsum(count[full]) - count[full], count[full])
            extra[np.repeat(np.arange(len(full)), count[full]), k] = src[np.repeat(first[full], count[full]) + k]
            self.edges[to[full], DEGREE:] = -1
            self.edges[to[full], :DEGREE] = self._pruned(to[full], np.concatenate([own[full], extra], 1))

    def _pruned(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of each node's candidates (-1: none)."""
        cand = np.sort(np.where(cand == nodes[:, None], -1, cand), 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        x = self.x[np.maximum(cand, 0)]
        far = np.where(cand < 0, np.inf, 2 - 2 * np.einsum("bd,bcd->bc", self.x[nodes], x))
        order = np.argsort(far, 1, kind="stable")[:, :PROPOSED]
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        x = self.x[np.maximum(cand, 0)]
        between = 2 - 2 * (x @ x.transpose(0, 2, 1))
        alive, rows = np.isfinite(far), np.arange(len(nodes))
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            best = alive.argmax(1)
            out[some, k] = cand[rows, best][some]
            alive[rows, best] = False
            alive &= ~(ALPHA * ALPHA * between[rows, best] <= far)
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam [query, beam] of nearest nodes found (-1: none), nearest first, and their dot products."""
        n, m = len(self.x), len(q)
        q = np.ascontiguousarray(q, np.float32)
        beam = min(beam, n)
        ids = np.full((m, beam), -1, np.int64)
        dots = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0], dots[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, q @ self.x[self.entry], True, True
        live, self.scored = np.arange(m), m
        while len(live):
            k = min(EXPANDED, beam)
            rank = np.where(open_[live], dots[live], -np.inf)
            at = np.argpartition(-rank, k - 1, 1)[:, :k] if k < beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            go = np.isfinite(np.take_along_axis(rank, at, 1))
            node = np.where(go, np.take_along_axis(ids[live], at, 1), -1)
            open_[live[:, None], at] = False
            near = np.where(node[:, :, None] >= 0, self.edges[np.maximum(node, 0)], -1).reshape(len(live), -1)
            # Neighbours of several nodes are scored once.
            near.sort(1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[live[:, None], near]
            row, col = np.nonzero(new)
            to = near[row, col]
            self.scored += len(to)
            seen[live[row], to] = True
            d = np.full(near.shape, -np.inf, np.float32)
            d[row, col] = np.einsum("md,md->m", q[live[row]], self.x[to])
            all_d = np.concatenate([dots[live], d], 1)
            best = np.argpartition(-all_d, beam - 1, 1)[:, :beam] if all_d.shape[1] > beam else np.broadcast_to(np.arange(all_d.shape[1]), all_d.shape)
            dots[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.where(np.isfinite(dots[live]), np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1), -1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new], 1), best, 1) & (ids[live] >= 0)
            live = live[open_[live].any(1)]
        order = np.lexsort((ids, -dots), axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dots, order, 1)


def _build(table: pa.Table) -> pa.Table:
    shard, out = table.column("shard")[0].as_py(), []
    ids = table.column("ids").to_pylist()
    for d, at, x in rows_of(table.column("v")):
        g = Graph(unit(x)).build()
        n = [len(ids[i]) for i in at]
        out.append({"shard": shard, "d": d, "x": x.tobytes(), "edges": g.edges.tobytes(), "sizes": np.array(n, np.int64).tobytes(), "ids": np.array([k for i in at for k in ids[i]], np.int64).tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("shard", pa.int64()), ("d", pa.int32()), ("x", pa.binary()), ("edges", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]))


def _search(k: int):
    def run(key, packs: pa.Table, index: pa.Table) -> pa.Table:
        q, c, s = [], [], []
        for r in index.to_pylist():
            x = np.frombuffer(r["x"]).reshape(-1, r["d"])
            g = Graph(unit(x), np.frombuffer(r["edges"], np.int32).reshape(-1, DEGREE))
            sizes, ids = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["ids"], np.int64)
            first = np.cumsum(sizes) - sizes
            for pack in packs.to_batches(1):
                pack = pack.to_pylist()[0] if pack.num_rows else {"query_ids": [], "queries": []}
                own = [(i, v) for i, v in zip(pack["query_ids"], pack["queries"]) if len(v) == r["d"]]
                if not own:
                    continue
                who, v = np.array([o[0] for o in own], np.int64), np.array([o[1] for o in own])
                found, _ = g.search(unit(v), BEAM)
                # k + 1 nodes suffice: a query's own id can only take one place.
                row, col = np.nonzero(found[:, : 4 * (k + 1)] >= 0)
                node = found[row, col]
                score = cosines(v[row], x[node])
                n = sizes[node]
                some = np.repeat(who[row], n), ids[np.repeat(first[node], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)], np.repeat(score, n)
                for all_, best in zip((q, c, s), _nearest(*some, k)):
                    all_.append(best)
            release()
        join = lambda parts, t: pa.array(np.concatenate([np.zeros(0, t), *parts]))
        return pa.table({"query_id": join(q, np.int64), "vec_id": join(c, np.int64), "score": join(s, np.float64)})

    return run


def _nearest(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates c by score s of each query q, ties to the smaller id, none of them the query."""
    keep = q != c
    q, c, s = q[keep], c[keep], s[keep]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], c[rank < k], s[rank < k]


def build_index(vectors: DataFrame, keep: int) -> tuple[DataFrame, int]:
    """One row for each shard and dimension: its vectors, graph, and the keep smallest ids of each vector; and the number of shards."""
    rows = usable(vectors).where("vec_id is not null").dropDuplicates(["vec_id", "node"])
    # Windows with a limit are cut on the map side: a vector that many rows hold sends a few.
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= keep)
    nodes = checkpointed(few.groupBy("node").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, math.ceil(nodes.count() / SHARD))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(17)), F.lit(shards)))
    return checkpointed(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_build, "shard long, d int, x binary, edges binary, sizes binary, ids binary")), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query its k nearest found: query_id, rank (from 1), vec_id, score."""
    index, shards = build_index(vectors, k + 1)
    asked = usable(queries).where("vec_id is not null").groupBy("vec_id").agg(F.min_by("v", "node").alias("v"))
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    packs = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("p"))
    # Every pack of queries goes to every shard; a shard is sent once for PACKS packs, which are about as large as it.
    groups = math.ceil(blocks / PACKS)
    packs = packs.select(F.pmod("block", F.lit(groups)).cast("long").alias("group"), F.col("p.vec_id").alias("query_ids"), F.col("p.v").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    asked = packs.withColumn("shard", F.col("shard").cast("long")).groupBy("shard", "group")
    searched = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("group", F.col("group").cast("long")).groupBy("shard", "group")
    found = asked.cogroup(searched).applyInArrow(_search(k), _schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
