"""Whole runs that write files: the co-occurrence export, the core's export, and the audit. Also a command line."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import schemas as S
from papyra.operators import audit as A
from papyra.operators import cooccurrence as C
from papyra.operators import layout as L
from papyra.operators import network as N
from papyra.operators import resolution as R
from papyra.operators import rules
from papyra.plans.durable import checkpointed
from papyra.sources import readers, sinks


def export_cooccurrence(mentions: DataFrame, folder: str, document_id: str, source: str = "", json_mentions: int | None = None) -> dict:
    """Nodes, sentences, edges, observations, pair summary, matrices, blocks and a summary."""
    spark = mentions.sparkSession
    rules.enforce(rules.mention_rules(mentions).union(rules.context_rules(mentions)))
    if mentions.isEmpty():
        raise rules.RuleError("no mentions")
    once = C.units(mentions, texts=True)
    nodes, sentences, edges = checkpointed(C.nodes(mentions, once)), checkpointed(C.sentences(mentions)), checkpointed(C.edges(mentions, once))
    table = C.edge_table(edges, nodes)
    obs = checkpointed(C.observations(mentions, once))
    ends = lambda p: nodes.select(F.col("matrix_index").alias(f"{p}_index"), F.col("canonical_id").alias(f"{p}_canonical_id"), F.col("canonical_name").alias(f"{p}_name"), F.col("category").alias(f"{p}_category"))
    named = obs.join(ends("source"), "source_index").join(ends("target"), "target_index").select("source_index", "target_index", "source_canonical_id", "target_canonical_id", "source_name", "target_name", "source_category", "target_category", *obs.columns[2:])
    sinks.csv_file(nodes.orderBy("matrix_index"), f"{folder}/nodes.csv")
    sinks.csv_file(sentences.orderBy("matrix_row").select("matrix_row", "document_id", "sentence_id", "mention_count", "unique_node_count", "context"), f"{folder}/sentences.csv")
    sinks.csv_file(table.orderBy("source_index", "target_index"), f"{folder}/edges.csv")
    sinks.csv_file(named.orderBy("sentence_row", "source_index", "target_index"), f"{folder}/edge_observations.csv")
    pairs = C.category_pairs(edges, nodes)
    sinks.csv_file(pairs.orderBy(S.rank_of("source_category", S.CATEGORIES), S.rank_of("target_category", S.CATEGORIES)), f"{folder}/category_pair_summary.csv")
    n, m = nodes.count(), sentences.count()
    sinks.matrix_market(C.incidence(mentions, once), f"{folder}/sentence_node_incidence.mtx", m, n, "Matriz binaria oración x entidad canónica", "matrix_row", "matrix_index")
    sinks.matrix_market(C.adjacency(edges), f"{folder}/cooccurrence_adjacency.mtx", n, n, "Matriz simétrica de coocurrencia; diagonal igual a cero")
    members, cells = checkpointed(C.group_members(nodes)), checkpointed(C.block_entries(edges, nodes))
    for g in S.GROUPS:
        sinks.csv_file(members.where(F.col("group") == g).orderBy("block_index").select("block_index", *C.NODE_FIELDS), f"{folder}/blocks/nodes_{g}.csv")
    manifest = [r.asDict() for r in C.block_manifest(edges, nodes).collect()]
    manifest.sort(key=lambda r: [b[0] for b in S.BLOCKS].index(r["matrix"]))
    for r in manifest:
        sinks.matrix_market(cells.where(F.col("matrix") == r["matrix"]), f"{folder}/blocks/{r['filename']}", r["rows"], r["columns"], f"Bloque de coocurrencia {r['row_group']} x {r['column_group']}")
    sinks.csv_file(spark.createDataFrame(manifest).select(*manifest[0]).orderBy(F.array_position(F.array(*(F.lit(b[0]) for b in S.BLOCKS)), F.col("matrix"))), f"{folder}/blocks/manifest.csv")
    c = C.summary(mentions).first().asDict()
    counts = {"json_mentions": json_mentions, **{k: c[k] for k in ("database_mentions", "sentences", "canonical_nodes", "sentence_node_presences", "undirected_edges", "edge_observations", "total_sentence_cooccurrences", "max_edge_weight")}}
    about = {
        "generated_at": datetime.now(UTC).isoformat(), "document_id": document_id, "ner_json": source,
        "definition": {"node": "canonical_id", "unit": "(document_id, sentence_id)", "edge": "two canonical_id in one unit", "weight": "distinct units of the pair", "deduplicate_node_within_sentence": True, "self_loops": False, "directed": False, "ambiguity_policy": "include_all", "normalization": "none"},
        "indexing": {"csv": "base_zero", "matrix_market": "base_one_per_format_specification"}, "counts": counts,
        "canonical_nodes_by_category": {k: c[f"nodes_{k}"] for k in S.CATEGORIES}, "mentions_by_ambiguity": {a: c[f"mentions_{a}"] for a in (*S.AMBIGUITIES, "other")}, "blocks": manifest,
    }
    sinks.json_file(spark, about, f"{folder}/summary.json")
    return about


def export_core(spark: SparkSession, analysis: str, folder: str, minimum_weight: int = 3, isolates: bool = False, seed: int = 42) -> dict:
    """Reads a co-occurrence export and writes its core: tables, GraphML, viewer and summary. The core is held by the driver."""
    nodes = readers.csv(spark, f"{analysis}/nodes.csv", readers.NODE_INTEGERS, "canonical_id")
    edges = readers.csv(spark, f"{analysis}/edges.csv", readers.EDGE_INTEGERS, "source_canonical_id")
    document_id = readers.summary(spark, f"{analysis}/summary.json").first()["document_id"]
    nodes = nodes.withColumn("layer", F.when(F.coalesce("layer", F.lit("")) == "", S.layer_of("category")).otherwise(F.col("layer")))
    core = checkpointed(N.core_edges(edges, minimum_weight))
    rules.enforce(rules.network_rules(nodes, core))
    if core.isEmpty():
        raise rules.RuleError(f"no edge reaches the weight {minimum_weight}")
    table = checkpointed(N.core_nodes(core, nodes, isolates))
    evidence = checkpointed(N.evidence(core, readers.csv(spark, f"{analysis}/edge_observations.csv"), readers.csv(spark, f"{analysis}/sentences.csv")))
    slug = f"g{minimum_weight}"
    fields = ("canonical_id", "canonical_name", "category", "layer", "matrix_index", "mention_count", "sentence_count", "degree", "strength", "component", "component_size", "ambiguity_low", "ambiguity_medium", "ambiguity_high")
    sinks.csv_file(N.ordered_nodes(table).select(*fields), f"{folder}/{slug}_nodes.csv")
    sinks.csv_file(N.edge_export(core, evidence).orderBy(F.desc("sentence_count"), *N.ENDS), f"{folder}/{slug}_edges.csv")
    sinks.graphml(table, core, f"{folder}/{slug}.graphml", document_id=document_id, minimum_weight=minimum_weight, edge_definition="same_sentence_cooccurrence")
    said: dict = {}
    for r in evidence.orderBy("document_id", "sentence_id").toLocalIterator():
        said.setdefault((r["a"], r["b"]), []).append({k: r[k] for k in ("document_id", "sentence_id", "context", "source_texts", "target_texts", "source_ambiguities", "target_ambiguities")})
    rows = [r.asDict() for r in N.visual_nodes(table).toLocalIterator()]
    links = [r.asDict() for r in core.toLocalIterator()]
    sinks.html(spark, L.payload(document_id, minimum_weight, rows, links, said, isolates, seed), f"{folder}/{slug}_interactive.html")
    sizes = [r["component_size"] for r in table.select("component", "component_size").distinct().orderBy("component").collect()]
    about = {
        "document_id": document_id, "network": f"G{minimum_weight}", "minimum_edge_weight": minimum_weight, "includes_isolates": isolates, "nodes": len(rows), "edges": len(links), "components": len(sizes), "component_sizes": sizes,
        "nodes_by_category": {r["category"]: r["nodes"] for r in N.category_counts(table).collect()}, "edges_by_category_pair": {r["category_pair"]: r["edges"] for r in N.pair_counts(core).orderBy("category_pair").collect()},
        "top_nodes_by_strength": [r.asDict() for r in N.top_by_strength(table).select("canonical_id", "canonical_name", "category", "degree", "strength").collect()],
        "outputs": {"interactive_html": f"{slug}_interactive.html", "graphml": f"{slug}.graphml", "nodes_csv": f"{slug}_nodes.csv", "edges_csv": f"{slug}_edges.csv"} | _figures(rows, links, folder, slug, minimum_weight),
    }
    sinks.json_file(spark, about, f"{folder}/{slug}_summary.json")
    return about


def _figures(nodes: list[dict], edges: list[dict], folder: str, slug: str, minimum_weight: int) -> dict:
    """Static drawings, where a drawing library is installed and the folder is local."""
    from importlib.util import find_spec

    if not find_spec("matplotlib") or "://" in folder:
        return {}
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    out = {}
    for kind, places in (("layered", L.layered(nodes)[0]), ("free", L.free(nodes, edges))):
        figure, ax = plt.subplots(figsize=(14, 9))
        for e in edges:
            (x0, y0), (x1, y1) = places[e[N.ENDS[0]]], places[e[N.ENDS[1]]]
            ax.plot([x0, x1], [y0, y1], color="#999999", linewidth=1 + 0.85 * max(e["sentence_count"] - minimum_weight + 1, 1) ** 0.5, zorder=1)
        for c, style in N.STYLES.items():
            own = [n for n in nodes if n["category"] == c]
            ax.scatter(*zip(*(places[n["canonical_id"]] for n in own)), s=[n["size"] for n in own], c=style["color"], marker=style["shape"], zorder=2) if own else None
        for n in sorted(nodes, key=lambda n: (-n["strength"], -n["degree"], n["canonical_name"].casefold()))[: N.LABELS if len(nodes) > N.MANY_NODES else None]:
            ax.annotate(n["canonical_name"], places[n["canonical_id"]], ha="center", fontsize=8)
        ax.set_title(N.title(minimum_weight))
        ax.axis("off")
        for ext in ("png", "svg"):
            figure.savefig(f"{folder}/{slug}_{kind}.{ext}")
            out[f"{kind}_{ext}"] = f"{slug}_{kind}.{ext}"
        plt.close(figure)
    return out


def export_audit(entities: DataFrame, stored: DataFrame, registry: DataFrame, aliases: DataFrame, document_id: str, folder: str) -> dict:
    """What resolving a document's entities anew would change; nothing is stored."""
    spark = entities.sparkSession
    signature = [F.col(c) for c in A.SIGNATURE]
    if not C.multiset_difference(entities.select(*signature), stored.select(*signature)).first()["equal"]:
        raise rules.RuleError("the file's mentions differ from the stored ones")
    base = checkpointed(A.aligned(entities, stored))
    resolved = checkpointed(R.resolve(entities.withColumn("document_id", F.lit(document_id)), registry, aliases))
    flat = resolved.select("*", *(F.col(f"resolution_details.{c}").alias(c) for c in ("preferred_name", "strategy", "rule", "reason", "base_match_type")))
    rows = checkpointed(A.decisions(base, flat))
    after = resolved.select(F.lit(document_id).alias("document_id"), "sentence_id", "canonical_id", "canonical_name", "category", "text", "start", "end", "context", "ambiguity")
    about = {"document_id": document_id, "mentions": rows.count(), "changed": rows.where("changed_canonical_id").count(), "statistics": {r["match_type"]: r["mentions"] for r in R.statistics(resolved).collect()}}
    sinks.csv_file(rows.orderBy("mention_index").drop("mention_index"), f"{folder}/decisions.csv", False)
    for t in about["statistics"]:
        sinks.csv_file(A.by_method(rows, t).orderBy("mention_index").drop("mention_index"), f"{folder}/decisions_{t}.csv", False)
    for name, frame in (("convergences", A.convergences(rows)), ("splits", A.splits(rows)), ("created", A.created(rows))):
        sinks.csv_file(frame, f"{folder}/{name}.csv", False)
    for name, m in (("before", stored), ("after", after)):
        once = C.units(m)
        nodes = checkpointed(C.nodes(m, once))
        table = checkpointed(C.edge_table(C.edges(m, once), nodes))
        about[name] = A.network_summary(nodes, table).first().asDict()
        sinks.csv_file(A.heavy_edges(table), f"{folder}/g3_edges_{name}.csv", False)
    sinks.json_file(spark, about, f"{folder}/summary.json")
    return about


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="papyra")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("cooccurrence", help="matrices of a document's mentions")
    a = sub.add_parser("audit", help="what resolving anew would change")
    for x in (c, a):
        x.add_argument("--ner-json", required=True)
        x.add_argument("--mentions", required=True, help="stored mentions (Parquet)")
        x.add_argument("--registry", required=True, help="canonical entities (Parquet)")
        x.add_argument("--output-dir", required=True)
    a.add_argument("--aliases", required=True)
    n = sub.add_parser("network", help="core of a co-occurrence export")
    n.add_argument("--analysis-dir", required=True)
    n.add_argument("--output-dir", required=True)
    n.add_argument("--minimum-weight", type=int, default=3)
    n.add_argument("--include-isolates", action="store_true")
    n.add_argument("--seed", type=int, default=42)
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("papyra").getOrCreate()
    if o.job == "network":
        print(export_core(spark, o.analysis_dir, o.output_dir, o.minimum_weight, o.include_isolates, o.seed))
        return
    entities = checkpointed(readers.ner_files(spark, o.ner_json))
    document_id = entities.first()["document_id"]
    registry = spark.read.parquet(o.registry)
    stored = checkpointed(readers.stored_mentions(spark.read.parquet(o.mentions), registry, document_id))
    rules.enforce(rules.join_rules(stored))
    if o.job == "audit":
        print(export_audit(entities, stored, registry, spark.read.parquet(o.aliases), document_id, o.output_dir))
        return
    signature = [F.col(x) for x in A.SIGNATURE]
    if not C.multiset_difference(entities.select(*signature), stored.select(*signature)).first()["equal"]:
        raise rules.RuleError("the file's mentions differ from the stored ones")
    print(export_cooccurrence(stored, o.output_dir, document_id, o.ner_json, entities.count())["counts"])


if __name__ == "__main__":
    main()
