"""Co-occurrence, core, exports and rules on small fixtures."""

import json
import re

import pytest

from papyra import schemas as S
from papyra.operators import audit as A
from papyra.operators import cooccurrence as C
from papyra.operators import network as N
from papyra.operators import ordering
from papyra.operators import rules as R
from papyra.operators.components import connected_components
from papyra.plans import jobs
from papyra.sources import readers, sinks

DOC = "00000000-0000-0000-0000-000000000001"
NAMES = {"a": ("Mineros", "CHAR"), "b": ("Minería artesanal", "PRAC"), "c": ("Madre de Dios", "LOC"), "p": ("p", "PRAC"), "i": ("i", "INFRA"), "g": ("g", "GOV")}


def mentions(spark, rows):
    out = []
    for k, (id_, sentence, start, *more) in enumerate(rows):
        name, category = NAMES[id_]
        category = more[0] if more else category
        out.append((DOC, sentence, id_, name, category, name, start, start + len(name), f"Contexto de {sentence}", "low", str(k)))
    return spark.createDataFrame(out, S.MENTION)


def test_repeat_in_a_unit_counts_once(spark):
    m = mentions(spark, [("a", "s-1", 0), ("a", "s-1", 20), ("b", "s-1", 40)])
    assert C.incidence(m).count() == 2
    assert [tuple(r) for r in C.edges(m).collect()] == [(0, 1, 1, 1)]
    o = C.observations(m).first()
    assert (o["source_mention_count"], o["target_mention_count"], o["source_texts"]) == (2, 1, "Mineros")


def test_two_units(spark):
    m = mentions(spark, [("a", "s-1", 0), ("b", "s-1", 20), ("a", "s-2", 100), ("b", "s-2", 120)])
    assert C.edges(m).first()["sentence_count"] == 2 and C.observations(m).count() == 2


def test_no_self_loop(spark):
    m = mentions(spark, [("a", "s-1", 0), ("a", "s-1", 20)])
    assert C.edges(m).count() == 0 and C.incidence(m).count() == 1


def test_one_identity(spark):
    with pytest.raises(R.RuleError):
        R.enforce(R.mention_rules(mentions(spark, [("a", "s-1", 0), ("a", "s-1", 20, "LOC")])))
    assert R.context_rules(mentions(spark, [("a", "s-1", 0)])).isEmpty()


def test_triangle_and_matrix(spark, tmp_path):
    m = mentions(spark, [("a", "s-1", 0), ("b", "s-1", 20), ("c", "s-1", 40)])
    cells = {(r["row"], r["column"]): r["value"] for r in C.adjacency(C.edges(m)).collect()}
    assert len(cells) == 6 and all(cells[j, i] == v and i != j for (i, j), v in cells.items())
    sinks.matrix_market(C.adjacency(C.edges(m)), f"{tmp_path}/a.mtx", 3, 3, "x")
    lines = (tmp_path / "a.mtx").read_text().splitlines()
    assert lines[0] == "%%MatrixMarket matrix coordinate integer general" and lines[3] == "3 3 6" and lines[4] == "1 2 1"


def test_pairs_inside_a_layer(spark):
    m = mentions(spark, [("p", "s-1", 0), ("i", "s-1", 20), ("g", "s-1", 40)])
    n, e = C.nodes(m), C.edges(m)
    seen = {(r["source_category"], r["target_category"]): r["observed_edges"] for r in C.category_pairs(e, n).collect()}
    assert len(seen) == 15 and [seen[x] for x in (("PRAC", "INFRA"), ("PRAC", "GOV"), ("INFRA", "GOV"))] == [1, 1, 1] and sum(seen.values()) == 3
    blocks = {r["matrix"]: (r["rows"], r["nonzero_cells"], r["undirected_edge_count"]) for r in C.block_manifest(e, n).collect()}
    assert len(blocks) == 12 and blocks["A_L2"] == (3, 6, 3) and blocks["B_PRAC__GOV"] == (1, 1, 1) and blocks["A_CHAR"] == (0, 0, 0)
    assert [(r["category_index"], r["layer_index"]) for r in n.orderBy("matrix_index").collect()] == [(0, 0), (0, 1), (0, 2)]


def test_multisets(spark):
    a = mentions(spark, [("a", "s-1", 0)]).select(*A.SIGNATURE)
    assert C.multiset_difference(a, a).first()["equal"]
    assert not C.multiset_difference(a, a.withColumn("text", a["category"])).first()["equal"]


def test_index_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ONE_WINDOW", 40)
    df = spark.range(500).selectExpr("id", "id % 7 as a", "string(id * 31 % 500) as b")
    got = [(r["a"], r["b"]) for r in ordering.with_index(df, "n", df["a"], df["b"]).orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 500
    assert sorted(r["n"] for r in ordering.with_index(df, "n", df["a"], df["b"]).collect()) == list(range(500))


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, few):
    e = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("z", "z"), (None, "a"), ("a", "d")], "a string, b string")
    assert {tuple(r) for r in connected_components(e, few=few).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    assert connected_components(e.limit(0), few=few).collect() == []


def network(spark):
    n = spark.createDataFrame([(0, 0, 0, "a", "Actores", "CHAR", "CHAR"), (1, 0, 0, "p", "Minería", "PRAC", "L2"), (2, 0, 1, "i", "Draga", "INFRA", "L2"), (3, 0, 2, "g", "Ley", "GOV", "L2"), (4, 0, 0, "l", "Territorio", "LOC", "LOC")], "matrix_index long, category_index long, layer_index long, canonical_id string, canonical_name string, category string, layer string")
    for c in C.NODE_FIELDS[7:]:
        n = n.selectExpr("*", f"1L as {c}")
    e = spark.createDataFrame([("a", "p", 5), ("p", "l", 3), ("p", "i", 2), ("i", "g", 1)], "source_canonical_id string, target_canonical_id string, sentence_count long")
    return n, e.selectExpr("*", "1L as document_count", "'x--y' as category_pair", "'x--y' as layer_pair")


def test_core(spark):
    n, e = network(spark)
    core = N.core_edges(e, 3)
    got = {r["canonical_id"]: r for r in N.core_nodes(core, n).collect()}
    assert set(got) == {"a", "p", "l"} and got["p"]["degree"] == 2 and got["p"]["strength"] == 8 and got["p"]["component"] == 1
    every = {r["canonical_id"]: r for r in N.core_nodes(core, n, True).collect()}
    assert len(every) == 5 and every["i"]["degree"] == 0 and {every["i"]["component"], every["g"]["component"]} == {2, 3}
    assert every["i"]["component"] == 2  # Draga before Ley
    assert N.core_nodes(N.core_edges(e, 1), n).count() == 5
    with pytest.raises(ValueError):
        N.core_edges(e, 0)
    assert [r["canonical_id"] for r in N.top_by_strength(N.core_nodes(core, n), 2).collect()] == ["p", "a"]
    assert N.labelled(N.core_nodes(core, n), 2, 1).count() == 1


def test_network_rules(spark):
    n, e = network(spark)
    bad = e.union(spark.createDataFrame([("p", "a", 9, 1, "", ""), ("a", "a", 9, 1, "", ""), ("a", "?", 9, 1, "", "")], e.schema))
    rules = {r["rule"] for r in R.network_rules(n.withColumn("layer", n["category"]).union(n.limit(1)), bad).collect()}
    assert rules == {"node_id", "node_layer", "self_loop", "endpoint", "edge_twice"}
    assert R.network_rules(n, e).isEmpty()


def test_exports(spark, tmp_path):
    rows = [(i, f"s-{k}", 20 * j) for k in range(4) for j, i in enumerate(("a", "b", "c"))] + [("p", "s-0", 100), ("i", "s-9", 0)]
    m = mentions(spark, rows)
    about = jobs.export_cooccurrence(m, f"{tmp_path}/co", DOC, "x.json", m.count())
    assert about["counts"]["undirected_edges"] == 6 and about["counts"]["max_edge_weight"] == 4 and about["canonical_nodes_by_category"]["PRAC"] == 2
    names = {p.name for p in (tmp_path / "co").iterdir() if p.suffix != ".crc"}
    assert names == {"nodes.csv", "sentences.csv", "edges.csv", "edge_observations.csv", "category_pair_summary.csv", "sentence_node_incidence.mtx", "cooccurrence_adjacency.mtx", "summary.json", "blocks"}
    core = jobs.export_core(spark, f"{tmp_path}/co", f"{tmp_path}/g", 3, True)
    assert core["nodes"] == 5 and core["edges"] == 3 and core["component_sizes"] == [3, 1, 1]
    html = (tmp_path / "g" / "g3_interactive.html").read_text()
    assert "Contexto de s-1" in html and "@DATA@" not in html and "</script>" in html
    payload = json.loads(re.search(r"const data = (.*);\n", html)[1].replace("<\\/", "</"))
    y = {n["category"]: n["layered"]["y"] for n in payload["nodes"]}
    assert y["CHAR"] < y["PRAC"] < y["INFRA"] < y["LOC"] and payload["nodeCount"] == 5
    assert (tmp_path / "g" / "g3.graphml").read_text().count("<edge ") == 3
    with pytest.raises(R.RuleError):
        jobs.export_core(spark, f"{tmp_path}/co", f"{tmp_path}/h", 99)


def test_readers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,n\na,1\nb,x\n")
    with pytest.raises(R.RuleError, match="n is not an integer"):
        readers.csv(spark, f"{tmp_path}/n.csv", ("n",), "id")
    e = {"text": "x", "category": "CHAR", "start": 0, "end": 1, "sentence_id": "s-0", "context": "x", "ambiguity": "low"}
    (tmp_path / "ok.json").write_text(json.dumps({"document_id": DOC, "entities": [e, e]}))
    assert [r["mention_index"] for r in readers.ner_files(spark, f"{tmp_path}/ok.json").collect()] == [0, 1]
    for k, bad in enumerate(({"document_id": "1", "entities": []}, {"document_id": DOC}, {"entities": [e]})):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(bad))
        with pytest.raises(R.RuleError):
            readers.ner_files(spark, f"{tmp_path}/bad{k}.json")
    files = readers.blobs(spark, str(tmp_path), "*.json")
    assert files.count() == 4
    got = {r["route"] for r in readers.converted(files, lambda c, p: ("t", 10), lambda c: "o").collect()}
    assert got == {"native"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, n int")
    sinks.replace_partitions(df, f"{tmp_path}/t")
    sinks.replace_partitions(spark.createDataFrame([("d2", 5)], df.schema), f"{tmp_path}/t")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select("document_id", "n").collect()} == {("d1", 1), ("d2", 5)}
    for _ in range(2):
        sinks.append_new(df, f"{tmp_path}/a", ["document_id"])
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    sinks.csv_file(df.limit(0), f"{tmp_path}/e.csv", False)
    assert (tmp_path / "e.csv").read_text() == ""
    sinks.csv_file(spark.createDataFrame([('a"b,c', 1)], df.schema), f"{tmp_path}/q.csv")
    assert (tmp_path / "q.csv").read_text() == 'document_id,n\n"a""b,c",1\n' or (tmp_path / "q.csv").read_bytes() == b'document_id,n\r\n"a""b,c",1\r\n'
    assert sinks.delete(spark, f"{tmp_path}/q.csv") and not sinks.delete(spark, None)
