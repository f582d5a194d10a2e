"""Embedding near-copies by a pigeonhole join in subspaces; exact.

For unit vectors, cosine >= c means squared distance <= 2 - 2c. Vectors are
rotated (a fixed random rotation spreads energy evenly) and split into BLOCKS
blocks of dimensions; each block has a share of that budget in proportion to its
dimensions, so a pair within the whole budget is within the share of at least
one block. Each block is range-joined on a grid over its first coordinates whose
cells are twice the block's radius wide: a vector stands in its own cell and
visits the lower cells that its radius reaches, so a pair meets once in a block.
A pair counts in the first block whose share it keeps, and is then verified by
the cosine of the original vectors in double precision.

Equal vectors are one node with a count, so copies never multiply. Crowded cells
are split into bounded groups, and a group gives each node its number of links
and its least linked node, never pairs. As the number of vectors grows, more
coordinates of a block are gridded.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of other dimensions don't link; repeated
rows with one vec_id link as any other rows; a null vec_id is never a
component's id while another is there; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.vectors import cosines, rows_of, unit, unusable, usable
from papyra.operators.components import connected_components
from papyra.plans.durable import checkpointed

COSINE = 0.95
BLOCKS = 4
#: Nodes of a cell that stand, and that visit, in one group.
STANDING, VISITING = 16384, 32768
CELL_NODES = 4096
SLACK = 1e-9
_placed = "cell long, block int, node long, home boolean"


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]


def cuts(d: int) -> np.ndarray:
    """Where the blocks of d dimensions begin and end."""
    return np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)


def shares(d: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine) * np.diff(cuts(d)) / d + SLACK


def _place(cosine: float, depth: int):
    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy()
            for d, at, x in rows_of(b.column(1)):
                y, c, budget = unit(x) @ rotation(d), cuts(d), shares(d, cosine)
                for k in range(len(c) - 1):
                    g, r = min(depth, c[k + 1] - c[k]), math.sqrt(budget[k])
                    z = y[:, c[k] : c[k] + g]
                    own, low, high = (np.floor(q / (2 * r)).astype(np.int64) for q in (z, z - r, z + r))
                    home = _cell(own, k, d)
                    yield _rows(home, k, node[at], True)
                    for step in itertools.product((0, 1), repeat=g):
                        to = np.where(np.array(step, bool), high, low)
                        # Each lower cell once: where low and high are one cell, only step 0 names it.
                        ok = ((np.array(step) == 0) | (high != low)).all(1)
                        cell = _cell(to, k, d)
                        ok &= _lower(to, own)
                        if ok.any():
                            yield _rows(cell[ok], k, node[at][ok], False)

    return run


def _lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row a comes before row b, coordinate by coordinate."""
    out, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
    for i in range(a.shape[1]):
        out |= equal & (a[:, i] < b[:, i])
        equal &= a[:, i] == b[:, i]
    return out


def _cell(at: np.ndarray, block: int, d: int) -> np.ndarray:
    h = np.full(len(at), block * 1_000_003 + d, np.uint64)
    for i in range(at.shape[1]):
        h = (h ^ at[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _rows(cell, block, node, home):
    n = len(cell)
    return pa.record_batch([pa.array(cell), pa.array(np.full(n, block, np.int32)), pa.array(node), pa.array(np.full(n, home))], names=["cell", "block", "node", "home"])


def _join(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        stands, visits = table.column("stands").to_numpy(zero_copy_only=False), table.column("visits").to_numpy(zero_copy_only=False)
        home = table.column("home").to_numpy(zero_copy_only=False)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for d, at, x in rows_of(table.column("v")):
            c, budget = cuts(d), shares(d, cosine)
            if block >= len(budget):
                continue
            y = unit(x) @ rotation(d)
            z = y[:, c[block] : c[block + 1]]
            # One product says whether a pair is within the block's share: z.w - |z|^2/2 - |w|^2/2 + share/2 >= 0.
            half, one = np.einsum("ij,ij->i", z, z)[:, None] / 2, np.ones((len(z), 1))
            near = np.hstack([z, budget[block] / 2 + 1e-4 - half, one]).astype(np.float32)
            far = np.hstack([z, one, -half]).astype(np.float32)
            left, right = np.flatnonzero(stands[at]), np.flatnonzero(visits[at])
            near, far = near[left], np.ascontiguousarray(far[right].T)
            for a in range(0, len(left), 256):
                for b in range(0, len(right), 1024):
                    g = near[a : a + 256] @ far[:, b : b + 1024]
                    if g.max() >= 0:
                        i, j = np.nonzero(g >= 0)
                        for p in range(0, len(i), 1 << 15):
                            _link(x, y, left[a + i[p : p + (1 << 15)]], right[b + j[p : p + (1 << 15)]], at, node, home, block, c, budget, cosine, n, links, label)
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[hit]), "links": pa.array(links[hit]), "least": pa.array(_least(node, label)[hit])})

    return run


def _link(x, y, i, j, at, node, home, block, c, budget, cosine, n, links, label):
    # Both at home here: each pair once.
    ok = (node[at[i]] < node[at[j]]) | ~home[at[j]]
    i, j = i[ok], j[ok]
    gap = np.add.reduceat((y[i] - y[j]) ** 2, c[:-1], axis=1)
    ok = (gap[:, block] <= budget[block]) & (gap[:, :block] > budget[:block]).all(1)
    i, j = i[ok], j[ok]
    ok = cosines(x[i], x[j]) >= cosine
    i, j = at[i[ok]], at[j[ok]]
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        m = np.minimum(a, b)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label[:] = label[label]


def _least(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    return least[label]


def vector_copies(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = usable(vectors)
    nodes = checkpointed(rows.groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")))
    depth = max(1, round(math.log(max(1, nodes.count()) / CELL_NODES + 1e-9, 3)))
    placed = nodes.select("node", "v").mapInArrow(_place(cosine, depth), _placed)
    crowd = placed.groupBy("cell").agg(F.count_if("home").alias("s"), F.count(F.lit(1)).alias("all"))
    crowd = crowd.where("s > 0 and all > 1").select("cell", F.ceil(F.col("s") / STANDING).alias("rows"), F.ceil(F.col("all") / VISITING).alias("columns"))
    # A group is one part of the standing rows with one part of all rows of the cell.
    own_row, own_column = F.pmod(F.xxhash64("node"), F.col("rows")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns"))
    spread = placed.join(crowd, "cell").withColumn("i", own_row).withColumn("j", own_column)
    where = F.expr("concat(transform(sequence(0L, rows - 1), x -> struct(x as r, j as c)), if(home, transform(filter(sequence(0L, columns - 1), y -> y != j), y -> struct(i as r, y as c)), array()))")
    grouped = spread.withColumn("at", F.explode(where)).select("cell", "block", "node", "home", F.col("at.r").alias("r"), F.col("at.c").alias("c"), (F.col("home") & (F.col("at.r") == F.col("i"))).alias("stands"), (F.col("at.c") == F.col("j")).alias("visits"))
    full = grouped.join(nodes, "node")
    found = checkpointed(full.groupBy("cell", "r", "c").applyInArrow(_join(cosine), "node long, links long, least long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    per = nodes.select("node", "n").join(counts, "node", "left").join(groups, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    own = rows.select("vec_id", "node").join(per, "node")
    ids = own.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = own.join(ids, "component").select("vec_id", "n_links", "component_id")
    # Rows that take no part keep themselves.
    apart = unusable(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
