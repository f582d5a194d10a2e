"""Before and after a resolution: decisions, convergences, splits, created canonicals, network figures.

A plan has no effect until it is written, so an audit is a dry run by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions.text import casefold, distinct_sorted
from papyra.operators import network as N

SIGNATURE = ("category", "text", "start", "end", "sentence_id", "context", "ambiguity")


def aligned(entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Entities (with mention_index) and the stored mention that each stands for: of equal signatures the k-th with the k-th."""
    nth = lambda d, *order: d.withColumn("_k", F.row_number().over(Window.partitionBy(*SIGNATURE).orderBy(*order)))
    left = nth(entities, "mention_index")
    right = nth(stored, "start", "end", "mention_id").select(*(F.col(c).alias(f"_{c}") for c in SIGNATURE), F.col("_k").alias("_j"), F.col("canonical_id").alias("old_canonical_id"), F.col("canonical_name").alias("old_canonical_name"))
    same = F.col("_k") == F.col("_j")
    for c in SIGNATURE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, same, "left").select(*entities.columns, "old_canonical_id", "old_canonical_name")


def decisions(aligned_entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row for each mention: old and new canonical, whether it changed, and how it was decided."""
    new = resolved.select("mention_index", F.col("canonical_id").alias("new_canonical_id"), F.col("canonical_name").alias("new_canonical_name"), "match_type", "match_score", "second_match_score", "preferred_name", "strategy", "rule", "reason", "base_match_type")
    d = aligned_entities.join(new, "mention_index")
    return d.select("mention_index", "sentence_id", "start", "end", "category", "text", "old_canonical_id", "old_canonical_name", "new_canonical_id", "new_canonical_name", (~F.col("old_canonical_id").eqNullSafe(F.col("new_canonical_id"))).alias("changed_canonical_id"), "match_type", "match_score", "second_match_score", "preferred_name", "strategy", F.coalesce("rule", F.lit("")).alias("rule"), "reason", "base_match_type")


def _joined(c: str, fold: bool = True) -> Column:
    return F.array_join(distinct_sorted(c) if fold else F.array_sort(F.collect_set(c)), " | ")


def _first(c: str) -> Column:
    return F.min_by(c, "mention_index")


def convergences(rows: DataFrame) -> DataFrame:
    """New canonicals that took in at least two old ones."""
    g = rows.groupBy("new_canonical_id").agg(_first("new_canonical_name").alias("new_canonical_name"), _first("category").alias("category"), F.count(F.lit(1)).alias("mention_count"), F.count_distinct("old_canonical_id").alias("old_canonical_count"), _joined("old_canonical_id", False).alias("old_canonical_ids"), _joined("old_canonical_name").alias("old_canonical_names"), _joined("text").alias("observed_texts"), _joined("match_type", False).alias("methods"))
    return g.where("old_canonical_count >= 2").orderBy(F.desc("mention_count"), casefold("new_canonical_name"), "new_canonical_id")


def splits(rows: DataFrame) -> DataFrame:
    """Old canonicals that went to at least two new ones."""
    g = rows.groupBy("old_canonical_id").agg(_first("old_canonical_name").alias("old_canonical_name"), _first("category").alias("category"), F.count(F.lit(1)).alias("mention_count"), F.count_distinct("new_canonical_id").alias("new_canonical_count"), _joined("new_canonical_id", False).alias("new_canonical_ids"), _joined("new_canonical_name").alias("new_canonical_names"), _joined("text").alias("observed_texts"))
    return g.where("new_canonical_count >= 2").orderBy(F.desc("mention_count"), casefold("old_canonical_name"), "old_canonical_id")


def created(rows: DataFrame) -> DataFrame:
    """Canonicals that the resolution made."""
    g = rows.where("base_match_type = 'new'").groupBy("new_canonical_id").agg(_first("new_canonical_name").alias("new_canonical_name"), _first("category").alias("category"), F.count(F.lit(1)).alias("mention_count"), _joined("text").alias("observed_texts"), _first("strategy").alias("strategy"), _first("reason").alias("reason"))
    return g.orderBy(F.desc("mention_count"), casefold("new_canonical_name"), "new_canonical_id")


def node_metrics(nodes: DataFrame, edge_table: DataFrame, minimum_weight: int = 3) -> DataFrame:
    """Degree and strength of every node in the whole network and in its core."""
    ends = edge_table.select(F.explode(F.array(*N.ENDS)).alias("canonical_id"), F.col("sentence_count").alias("w"))
    core = F.col("w") >= minimum_weight
    m = ends.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("degree_g1"), F.sum("w").alias("strength_g1"), F.count_if(core).alias("degree_g3"), F.sum(F.when(core, F.col("w")).otherwise(0)).alias("strength_g3"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(m, "canonical_id", "left").select("canonical_id", "canonical_name", "category", "mention_count", "sentence_count", z("degree_g1"), z("strength_g1"), z("degree_g3"), z("strength_g3"))


def network_summary(nodes: DataFrame, edge_table: DataFrame, minimum_weight: int = 3) -> DataFrame:
    """One row: nodes, edges and weights of the network and of its core."""
    w, core = F.col("sentence_count"), F.col("sentence_count") >= minimum_weight
    e = edge_table.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(w), F.lit(0)).alias("total_edge_weight"), F.coalesce(F.max(w), F.lit(0)).alias("max_edge_weight"), F.count_if(core).alias("g3_edges"), F.coalesce(F.sum(F.when(core, w)), F.lit(0)).alias("g3_total_edge_weight"))
    inside = edge_table.where(core).select(F.explode(F.array(*N.ENDS)).alias("n")).agg(F.count_distinct("n").alias("g3_nodes"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e).crossJoin(inside)


def heavy_edges(edge_table: DataFrame, minimum_weight: int = 3) -> DataFrame:
    rows = edge_table.where(F.col("sentence_count") >= minimum_weight).select("source_canonical_id", "source_name", "source_category", "target_canonical_id", "target_name", "target_category", "sentence_count")
    return rows.orderBy(F.desc("sentence_count"), casefold("source_name"), casefold("target_name"), "source_canonical_id", "target_canonical_id")


def focus(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """For each named predicate on the mention: how many, their texts, and the ids before and after."""
    out = None
    for name, p in predicates.items():
        r = rows.where(p).agg(F.count(F.lit(1)).alias("mention_count"), _joined("text").alias("observed_texts"), _joined("old_canonical_id", False).alias("before"), _joined("new_canonical_id", False).alias("after")).withColumn("focus", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def by_method(rows: DataFrame, method: str) -> DataFrame:
    return rows.where(F.col("match_type") == method)
