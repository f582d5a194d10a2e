"""Connected components of an edge list, by alternating large and small stars.

Each round rewires every node to the least node it knows, so chains shrink by
halves and hubs never meet in one task: minima are pre-aggregated on the map side
and joined back, and a round's edges are cut off their lineage in the shared
checkpoint folder. Edge sets of at most FEW_EDGES (counted first) are done by one
task with arrays instead, as rounds of small exchanges would cost more than the
work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.plans.durable import checkpointed

#: Edges that one task may hold: some tens of MB.
FEW_EDGES = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the least node reachable over the edges (a, b)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        if (label[a] == m).all() and (label[b] == m).all():
            return label
        # Roots are hooked to the smaller root, then every node looks up its root's label.
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(batches):
    batches = list(batches)
    if batches:
        tables = pa.Table.from_batches(batches)
        kind = tables.schema.field(0).type
        u, v = (np.array(tables.column(i).to_pylist(), dtype=object if pa.types.is_string(kind) else None) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = least_labels(at[: len(u)], at[len(u) :], len(nodes))
        yield pa.record_batch([pa.array(nodes, kind), pa.array(nodes[label], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """Rows (node, component): the least node reachable, for each node of an edge; self-loops and nulls are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = checkpointed(e)
    seen = _mark(e)
    if seen[0] <= few:
        kind = dict(e.dtypes)["u"]
        return e.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, component {kind}")
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    """A fingerprint of an edge set: the rounds end when it stays."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]
