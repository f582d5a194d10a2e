"""The thresholded network: core, components, degree and strength, evidence, and what a viewer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import schemas as S
from papyra.functions.text import casefold
from papyra.operators.components import connected_components
from papyra.operators.ordering import with_index
from papyra.plans.durable import checkpointed

ENDS = ("source_canonical_id", "target_canonical_id")
TOP, MANY_NODES, LABELS = 10, 80, 25
# Fixed values of the drawing: rows of the layered layout, and colours and marks of the categories.
LAYERED_Y = {"CHAR": 4.2, "PRAC": 2.7, "INFRA": 2.0, "GOV": 1.3, "LOC": 0.0}
STYLES = {
    "CHAR": {"color": "#E69F00", "shape": "o", "label": "CHAR"},
    "PRAC": {"color": "#009E73", "shape": "s", "label": "PRAC"},
    "INFRA": {"color": "#0072B2", "shape": "D", "label": "INFRA"},
    "GOV": {"color": "#CC79A7", "shape": "P", "label": "GOV"},
    "LOC": {"color": "#56B4E9", "shape": "h", "label": "LOC"},
}


def core_edges(edge_table: DataFrame, minimum_weight: int = 3) -> DataFrame:
    """Edges whose weight reaches the threshold."""
    if minimum_weight < 1:
        raise ValueError("the minimum weight is at least 1")
    return edge_table.where(F.col("sentence_count") >= minimum_weight)


def _ends(core: DataFrame) -> DataFrame:
    return core.select(F.explode(F.array(*ENDS)).alias("canonical_id"), F.col("sentence_count").alias("weight"))


def degrees(core: DataFrame) -> DataFrame:
    """canonical_id, degree and strength (weighted degree) of the nodes of the core."""
    return _ends(core).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def components(core: DataFrame, nodes: DataFrame, isolates: bool = False) -> DataFrame:
    """canonical_id, component (from 1) and component_size, larger components first, then by their sorted folded names.

    With isolates every node without an edge is a component of its own. Names are
    gathered for components of a size that another has too, which the largest of a
    corpus hasn't.
    """
    found = connected_components(core, *ENDS).select(F.col("node").alias("canonical_id"), F.col("component").alias("root"))
    if isolates:
        found = nodes.select("canonical_id").join(found, "canonical_id", "left").withColumn("root", F.coalesce("root", "canonical_id"))
    found = checkpointed(found)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("component_size"))
    tied = sizes.join(sizes.groupBy("component_size").count().where("count > 1").select("component_size"), "component_size")
    names = found.join(tied.select("root"), "root").join(nodes.select("canonical_id", casefold("canonical_name").alias("_n")), "canonical_id")
    names = names.groupBy("root").agg(F.array_sort(F.collect_list("_n")).alias("_names"))
    order = (F.desc("component_size"), F.col("_names"), F.col("root"))
    ranked = with_index(sizes.join(names, "root", "left"), "_r", *order).select("root", "component_size", (F.col("_r") + 1).cast("int").alias("component"))
    return found.join(ranked, "root").select("canonical_id", "component", "component_size")


def core_nodes(core: DataFrame, nodes: DataFrame, isolates: bool = False) -> DataFrame:
    """Nodes of the core with degree, strength and component; with isolates all nodes, theirs zero."""
    d = degrees(core)
    joined = nodes.join(d, "canonical_id", "left" if isolates else "inner").join(components(core, nodes, isolates), "canonical_id")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("strength", F.coalesce("strength", F.lit(0)))


def ordered_nodes(core_node_table: DataFrame) -> DataFrame:
    """In the order of the export: component, category, folded name."""
    return core_node_table.orderBy("component", S.rank_of("category", S.CATEGORIES), casefold("canonical_name"), "canonical_id")


def top_by_strength(core_node_table: DataFrame, k: int = TOP) -> DataFrame:
    return core_node_table.orderBy(F.desc("strength"), F.desc("degree"), "canonical_name", "canonical_id").limit(k)


def labelled(core_node_table: DataFrame, many: int = MANY_NODES, k: int = LABELS) -> DataFrame:
    """The nodes that get a label: all, or the strongest k where there are more than many."""
    if core_node_table.limit(many + 1).count() <= many:
        return core_node_table
    return core_node_table.orderBy(F.desc("strength"), F.desc("degree"), casefold("canonical_name"), "canonical_id").limit(k)


def pair_counts(core: DataFrame) -> DataFrame:
    return core.groupBy("category_pair").agg(F.count(F.lit(1)).alias("edges"))


def category_counts(core_node_table: DataFrame) -> DataFrame:
    """Nodes of every category, zero included."""
    frame = core_node_table.sparkSession.createDataFrame([(c,) for c in S.CATEGORIES], "category string")
    return frame.join(core_node_table.groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("nodes"))


def evidence(core: DataFrame, observations: DataFrame, sentences: DataFrame) -> DataFrame:
    """Observations of the surviving edges, either way round, each with its sentence's context (empty if unknown)."""
    key = lambda d: d.withColumn("a", F.least(*ENDS)).withColumn("b", F.greatest(*ENDS))
    kept = key(observations).join(key(core).select("a", "b"), ["a", "b"], "left_semi")
    context = sentences.select("document_id", "sentence_id", "context")
    return kept.join(context, ["document_id", "sentence_id"], "left").select("a", "b", "document_id", "sentence_id", F.coalesce("context", F.lit("")).alias("context"), "source_texts", "target_texts", "source_ambiguities", "target_ambiguities")


def edge_export(core: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """Core edges with the number of their evidence rows."""
    n = evidence_rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("evidence_count"))
    e = core.withColumn("a", F.least(*ENDS)).withColumn("b", F.greatest(*ENDS)).join(n, ["a", "b"], "left")
    return e.select(*ENDS, "source_name", "target_name", "source_category", "target_category", "category_pair", "layer_pair", "sentence_count", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def _root_share(strength: str, most: Column) -> Column:
    return F.sqrt(F.col(strength) / most)


def visual_nodes(core_node_table: DataFrame) -> DataFrame:
    """radius of the viewer and size of the figure for each node."""
    most = core_node_table.agg(F.max("strength").alias("_most"))
    n = core_node_table.crossJoin(most)  # one row
    radius = F.bround(8.0 + 9.0 * _root_share("strength", F.greatest("_most", F.lit(1))), 2)
    size = F.when(F.col("_most") <= 0, 650.0).otherwise(520.0 + 1180.0 * _root_share("strength", F.nullif("_most", F.lit(0))))
    return n.withColumn("radius", radius).withColumn("size", size).drop("_most")


def edge_width(weight: str, minimum_weight: int) -> Column:
    return 1.0 + 0.85 * F.sqrt(F.greatest(F.col(weight) - minimum_weight + 1, F.lit(1)))


def title(minimum_weight: int) -> str:
    names = {1: "G₁ · Red completa de coocurrencia", 3: "G₃ · Núcleo recurrente de coocurrencia"}
    return names.get(minimum_weight, f"G{minimum_weight} · Red de coocurrencia")


def core_summary(core: DataFrame, core_node_table: DataFrame) -> DataFrame:
    """One row: nodes, edges, components and the largest weight."""
    n = core_node_table.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    return n.crossJoin(core.agg(F.count(F.lit(1)).alias("edges"), F.max("sentence_count").alias("maximum_weight")))
