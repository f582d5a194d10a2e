"""The sentence co-occurrence network of mentions.

A unit is (document_id, sentence_id); a node is a canonical_id; an edge joins two
nodes that share a unit, and its weight is the number of such units. Mentions are
first reduced to one row for each unit and node, which every other table reuses;
pairs are an equi-join on the unit, so a unit's pairs are made where its rows
meet. Nothing is broadcast by force: Spark picks that by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import schemas as S
from papyra.functions.text import casefold, distinct_sorted
from papyra.operators.ordering import with_index
from papyra.plans.durable import checkpointed

UNIT = ["document_id", "sentence_id"]
NODE_FIELDS = ("matrix_index", "category_index", "layer_index", "canonical_id", "canonical_name", "category", "layer", "mention_count", "sentence_count", "document_count", "ambiguity_low", "ambiguity_medium", "ambiguity_high", "ambiguity_other")


def units(mentions: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each unit and node with its names and counts, computed once; with texts also what its mentions say.

    Nodes, edges and observations start from it; callers that need several of them
    pass it on.
    """
    is_ = lambda x: F.count_if(F.coalesce(F.col("ambiguity") == x, F.lit(False)))
    other = F.count_if(~F.coalesce(F.col("ambiguity").isin(*S.AMBIGUITIES), F.lit(False)))
    said = (distinct_sorted("text").alias("texts"), distinct_sorted("ambiguity").alias("ambiguities")) if texts else ()
    u = mentions.groupBy(*UNIT, "canonical_id").agg(
        F.max("canonical_name").alias("canonical_name"), F.max("category").alias("category"), F.count(F.lit(1)).alias("mention_count"),
        *(is_(a).alias(f"ambiguity_{a}") for a in S.AMBIGUITIES), other.alias("ambiguity_other"), *said,
    )
    return checkpointed(u)


def _in_order(n: DataFrame) -> DataFrame:
    """Nodes with their matrix_index."""
    n = n.withColumn("_r", S.rank_of("category", S.CATEGORIES)).withColumn("_f", casefold("canonical_name"))
    return with_index(n, "matrix_index", F.col("_r"), F.col("_f"), F.col("canonical_id"))


def nodes(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """One row for each canonical_id with its indices and counts (NODE_FIELDS)."""
    counts = [c for c in NODE_FIELDS if c == "mention_count" or c.startswith("ambiguity_")]
    n = (once if once is not None else units(mentions)).groupBy("canonical_id").agg(
        F.max("canonical_name").alias("canonical_name"), F.max("category").alias("category"),
        F.count(F.lit(1)).alias("sentence_count"), F.count_distinct("document_id").alias("document_count"), *(F.sum(c).alias(c) for c in counts),
    )
    n = _in_order(n.withColumn("layer", S.layer_of("category")))
    # An index inside a category or layer is the distance to its first index, or counts on past other categories.
    for column, by in (("category_index", "category"), ("layer_index", "layer")):
        sizes = n.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("_n"), F.min("matrix_index").alias("_first"))
        before = Window.partitionBy(by).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_shift", F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).select("category", "_shift")
        n = n.join(sizes, "category").withColumn(column, F.col("matrix_index") - F.col("_shift")).drop("_shift")
    return n.select(*NODE_FIELDS)


def indices(once: DataFrame) -> DataFrame:
    """canonical_id and matrix_index, as in nodes, without its counts."""
    n = once.groupBy("canonical_id").agg(F.max("canonical_name").alias("canonical_name"), F.max("category").alias("category"))
    return _in_order(n).select("canonical_id", "matrix_index")


def sentence_rows(once: DataFrame) -> DataFrame:
    """Each unit's row in the matrix."""
    return with_index(once.select(*UNIT).distinct(), "matrix_row", F.col("document_id"), F.col("sentence_id"))


def sentences(mentions: DataFrame) -> DataFrame:
    """One row for each unit: its row in the matrix, context (empty if none), mentions and distinct nodes."""
    s = mentions.groupBy(*UNIT).agg(F.coalesce(F.max(F.nullif("context", F.lit(""))), F.lit("")).alias("context"), F.count(F.lit(1)).alias("mention_count"), F.count_distinct("canonical_id").alias("unique_node_count"))
    return with_index(s, "matrix_row", F.col("document_id"), F.col("sentence_id")).select("matrix_row", *UNIT, "context", "mention_count", "unique_node_count")


def incidence(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Entries (matrix_row, matrix_index, value 1) of the binary matrix of sentences and nodes."""
    once = once if once is not None else units(mentions)
    return once.join(sentence_rows(once), UNIT).join(indices(once), "canonical_id").select("matrix_row", "matrix_index", F.lit(1).alias("value"))


def _pairs(once: DataFrame, *carried: str) -> DataFrame:
    indexed = once.select(*UNIT, "canonical_id", *carried).join(indices(once), "canonical_id").drop("canonical_id")
    side = lambda p: indexed.select(*UNIT, *(F.col(c).alias(f"{p}_{c}") for c in indexed.columns if c not in UNIT))
    return side("source").join(side("target"), UNIT).where("source_matrix_index < target_matrix_index").withColumnsRenamed({"source_matrix_index": "source_index", "target_matrix_index": "target_index"})


def edges(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """source_index < target_index, sentence_count (the weight) and document_count."""
    pairs = _pairs(once if once is not None else units(mentions))
    return pairs.groupBy("source_index", "target_index").agg(F.count(F.lit(1)).alias("sentence_count"), F.count_distinct("document_id").alias("document_count"))


def observations(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """One row for each edge and unit with both sides' mention counts, texts and ambiguities joined by ' | '; once is units with texts."""
    once = once if once is not None else units(mentions, texts=True)
    said = lambda c: F.array_join(c, " | ").alias(c)
    p = _pairs(once, "mention_count", "texts", "ambiguities").join(sentence_rows(once).withColumnRenamed("matrix_row", "sentence_row"), UNIT)
    return p.select("source_index", "target_index", "sentence_row", *UNIT, "source_mention_count", "target_mention_count", *(said(f"{s}_{c}") for c in ("texts", "ambiguities") for s in ("source", "target")))


def adjacency(edge_list: DataFrame) -> DataFrame:
    """Symmetric entries (row, column, value) with a zero diagonal."""
    return edge_list.select(F.col("source_index").alias("row"), F.col("target_index").alias("column"), F.col("sentence_count").alias("value")).union(edge_list.select("target_index", "source_index", "sentence_count"))


def category_pair(a: str, b: str) -> Column:
    first = S.rank_of(a, S.CATEGORIES) <= S.rank_of(b, S.CATEGORIES)
    return F.when(first, F.concat_ws("--", a, b)).otherwise(F.concat_ws("--", b, a))


def layer_pair(a: str, b: str) -> Column:
    first = S.rank_of(a, S.LAYERS) <= S.rank_of(b, S.LAYERS)
    return F.when(first, F.concat_ws("--", a, b)).otherwise(F.concat_ws("--", b, a))


def edge_table(edge_list: DataFrame, node_list: DataFrame) -> DataFrame:
    """Edges with both nodes' ids, names, categories and layers, and the ordered pairs of these."""
    side = lambda p: node_list.select(F.col("matrix_index").alias(f"{p}_index"), F.col("canonical_id").alias(f"{p}_canonical_id"), F.col("canonical_name").alias(f"{p}_name"), F.col("category").alias(f"{p}_category"), F.col("layer").alias(f"{p}_layer"))
    e = edge_list.join(side("source"), "source_index").join(side("target"), "target_index")
    both = lambda c: (f"source_{c}", f"target_{c}")
    return e.select(*both("index"), *both("canonical_id"), *both("name"), *both("category"), *both("layer"), category_pair(*both("category")).alias("category_pair"), layer_pair(*both("layer")).alias("layer_pair"), "sentence_count", "document_count")


def group_members(node_list: DataFrame) -> DataFrame:
    """Each node in each of its groups, with its index there (group_size rows in a group)."""
    m = node_list.join(S.groups(node_list.sparkSession), "category")
    sizes = m.groupBy("group", "category").agg(F.count(F.lit(1)).alias("_n"), F.min("matrix_index").alias("_first"))
    before = Window.partitionBy("group").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return m.join(sizes, ["group", "category"]).withColumn("block_index", F.col("matrix_index") - F.col("_first") + F.col("_before")).drop("_first", "_before")


def block_entries(edge_list: DataFrame, node_list: DataFrame) -> DataFrame:
    """Entries (matrix, row, column, value) of all twelve block matrices, in one plan.

    Square blocks are symmetric; a rectangular one always has its row group's node as row.
    """
    spark = edge_list.sparkSession
    member = group_members(node_list).select("group", "matrix_index", "block_index")
    side = lambda group, index, local: member.select(F.col("group").alias(group), F.col("matrix_index").alias(index), F.col("block_index").alias(local))
    both_ways = adjacency(edge_list)
    cells = both_ways.join(side("row_group", "row", "r"), "row").join(side("column_group", "column", "c"), "column")
    return cells.join(S.blocks(spark), ["row_group", "column_group"]).select("matrix", F.col("r").alias("row"), F.col("c").alias("column"), "value")


def block_manifest(edge_list: DataFrame, node_list: DataFrame) -> DataFrame:
    """One row for each block: its size, non-zero cells, edges and total weight."""
    spark = edge_list.sparkSession
    sums = block_entries(edge_list, node_list).groupBy("matrix").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
    size = S.groups(spark).join(node_list.groupBy("category").count(), "category", "left").groupBy("group").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    twice = F.when(F.col("row_group") == F.col("column_group"), 2).otherwise(1)
    rows = size.select(F.col("group").alias("row_group"), F.col("n").alias("rows"))
    columns = size.select(F.col("group").alias("column_group"), F.col("n").alias("columns"))
    m = S.blocks(spark).join(sums, "matrix", "left").join(rows, "row_group").join(columns, "column_group")
    cells = F.coalesce("cells", F.lit(0))
    return m.select("matrix", F.concat("matrix", F.lit(".mtx")).alias("filename"), "row_group", "column_group", "rows", "columns", cells.alias("nonzero_cells"), (cells / twice).cast("long").alias("undirected_edge_count"), (F.coalesce("total", F.lit(0)) / twice).cast("long").alias("total_sentence_cooccurrences"))


def category_pairs(edge_list: DataFrame, node_list: DataFrame) -> DataFrame:
    """All 15 pairs of categories with possible and observed edges, density and weights."""
    spark = edge_list.sparkSession
    pairs = [(a, b) for i, a in enumerate(S.CATEGORIES) for b in S.CATEGORIES[i:]]
    frame = spark.createDataFrame(pairs, "source_category string, target_category string")
    e = edge_table(edge_list, node_list).groupBy(F.col("category_pair")).agg(F.count(F.lit(1)).alias("n"), F.sum("sentence_count").alias("w"), F.max("sentence_count").alias("m"))
    counts = node_list.groupBy("category").count()
    side = lambda p: counts.select(F.col("category").alias(f"{p}_category"), F.col("count").alias(f"{p}_n"))
    f = frame.join(side("source"), "source_category", "left").join(side("target"), "target_category", "left").join(e, F.concat_ws("--", "source_category", "target_category") == F.col("category_pair"), "left")
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    s, t = z("source_n"), z("target_n")
    possible = F.when(F.col("source_category") == F.col("target_category"), F.floor(s * (s - 1) / 2)).otherwise(s * t).cast("long")
    rounded = lambda a, b, d: F.when(b > 0, F.bround(a / b, d)).otherwise(0.0)
    return f.select("source_category", "target_category", s.alias("source_nodes"), t.alias("target_nodes"), possible.alias("possible_pairs"), z("n").alias("observed_edges"), rounded(z("n"), possible, 8).alias("density"), z("w").alias("total_sentence_cooccurrences"), rounded(z("w"), z("n"), 6).alias("mean_weight_observed_edges"), z("m").alias("max_weight"))


def summary(mentions: DataFrame) -> DataFrame:
    """One row: the counts of the run, nodes by category, mentions by ambiguity."""
    once = units(mentions)
    n = nodes(mentions, once)
    per_node = n.agg(F.sum("mention_count").alias("database_mentions"), F.count(F.lit(1)).alias("canonical_nodes"), *(F.count_if(F.col("category") == c).alias(f"nodes_{c}") for c in S.CATEGORIES), *(F.sum(f"ambiguity_{a}").alias(f"mentions_{a}") for a in (*S.AMBIGUITIES, "other")))
    per_unit = once.groupBy(*UNIT).count().agg(F.count(F.lit(1)).alias("sentences"), F.sum("count").alias("sentence_node_presences"), F.sum(F.floor(F.col("count") * (F.col("count") - 1) / 2)).cast("long").alias("edge_observations"))
    per_edge = edges(mentions, once).agg(F.count(F.lit(1)).alias("undirected_edges"), F.coalesce(F.sum("sentence_count"), F.lit(0)).alias("total_sentence_cooccurrences"), F.coalesce(F.max("sentence_count"), F.lit(0)).alias("max_edge_weight"))
    # Three rows of one line each.
    return per_node.crossJoin(per_unit).crossJoin(per_edge)


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows each side has beyond the other, null equal to null, on the columns of left."""
    only = lambda a, b, name: a.exceptAll(b).agg(F.count(F.lit(1)).alias(name))
    right = right.select(*left.columns)
    return only(left, right, "only_left").crossJoin(only(right, left, "only_right")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
