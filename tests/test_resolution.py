"""Names, the resolution cascade, audits, and incremental runs."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import names as N
from papyra.operators import audit as A
from papyra.operators import lifecycle, rules
from papyra.operators import resolution as R
from papyra.plans import catalog, jobs, registry_queries
from papyra.streaming import incremental

FULL = "Griselda Zubizarreta Vargas"


def resolve(spark, registry, mentions, aliases=()):
    r = spark.createDataFrame([(str(i), n, c) for i, (n, c) in enumerate(registry)], "id string, canonical_name string, category string")
    a = spark.createDataFrame(list(aliases), "canonical_id string, normalized_alias string")
    m = spark.createDataFrame([("d", i, t, c) for i, (t, c) in enumerate(mentions)], "document_id string, mention_index int, text string, category string")
    return R.resolve(m, r, a).orderBy("mention_index").collect()


@pytest.mark.parametrize(
    ("registry", "mentions", "aliases", "want"),
    [
        ([("Madre de Dios", "LOC")], [("MADRE DE DIÓS", "LOC")], [], ["exact"]),
        ([("Madre de Dios", "CHAR")], [("Madre de Dios", "LOC")], [], ["new"]),
        ([("Puerto Maldonado", "LOC")], [("Puerto Maldonadoo", "LOC")], [], ["fuzzy"]),
        ([("Oro", "PRAC")], [("Ora", "PRAC")], [], ["new"]),
        ([("Puerto Maldonado", "LOC"), ("Puerto Maldonados", "LOC")], [("Puerto Maldonadoo", "LOC")], [], ["new"]),
        ([], [(x, "CHAR") for x in ("MINEROS", "mineros", "minero", "mineras", "minera")], [], ["morphology", "morphology", "new", "morphology", "new"]),
        ([], [("mineros", "CHAR"), ("mineros artesanales", "CHAR")], [], ["morphology", "morphology"]),
        ([(FULL, "CHAR")], [(FULL, "CHAR"), ("Griselda Zubizarreta", "CHAR"), ("Griselda", "CHAR")], [], ["exact", "person_alias", "person_alias"]),
        ([], [("Griselda Pérez", "CHAR"), ("Griselda Zubizarreta", "CHAR"), ("Griselda", "CHAR")], [], ["new", "new", "new"]),
        ([], [("Conirsa", "CHAR"), ("Conirsa SA", "CHAR")], [], ["new", "new"]),
        ([(FULL, "CHAR")], [("Griselda Zubizarreta", "CHAR")], [], ["person_name"]),
        ([(FULL, "CHAR")], [("G. Zubizarreta", "CHAR")], [("0", "g. zubizarreta")], ["stored_alias"]),
        ([(FULL, "CHAR")], [("Griselda", "CHAR")], [("0", "griselda")], ["new"]),
        ([("Minero", "CHAR")], [("minero", "CHAR")], [], ["new"]),
        ([], [("Río Tambopata Alto", "LOC"), ("Río Tambopata Altoo", "LOC")], [], ["new", "fuzzy"]),
    ],
)
def test_cascade(spark, registry, mentions, aliases, want):
    got = resolve(spark, registry, mentions, aliases)
    assert [r["match_type"] for r in got] == want
    assert all(r["resolution_version"] == "deterministic-v2" for r in got)


def test_scores_and_names(spark):
    r = resolve(spark, [("Puerto Maldonado", "LOC")], [("Puerto Maldonadoo", "LOC")])[0]
    assert (r["match_score"], r["second_match_score"], r["canonical_name"]) == (96.97, None, "Puerto Maldonado")
    r = resolve(spark, [(FULL, "CHAR")], [(FULL, "CHAR"), ("Griselda", "CHAR")])
    assert {x["canonical_id"] for x in r} == {"0"} and r[1]["match_score"] == 95.0
    assert r[1]["resolution_details"]["document_anchors"] == [FULL]
    assert {x["canonical_name"] for x in resolve(spark, [], [("mineros", "CHAR"), ("mineros artesanales", "CHAR")])} == {"minero", "minero artesanal"}


def test_pruning_keeps_decisions(spark):
    registry = spark.createDataFrame([(str(i), n, "LOC") for i, n in enumerate(("Puerto Maldonado", "Puerto", "Inambari", "Boca Colorado"))], "id string, canonical_name string, category string")
    m = spark.createDataFrame([("d", i, t, "LOC") for i, t in enumerate(("Puerto Maldonadoo", "Inambary", "Boca Coloradu", "Lima"))], "document_id string, mention_index int, text string, category string")
    a = spark.createDataFrame([], "canonical_id string, normalized_alias string")
    kinds = [sorted((r["mention_index"], r["match_type"], r["canonical_id"]) for r in R.resolve(m, registry, a, p).collect()) for p in (False, True)]
    assert kinds[0] == kinds[1]


def test_words():
    assert N.normalize("  RÍO   Madre de Dios ") == "rio madre de dios"
    want = {"MINEROS": "minero", "mineras": "minera", "docentes": "docente", "presidentes": "presidente", "mineros artesanales": "minero artesanal", "Asociación de Pequeños Mineros": None, "mineros que abandonaron la minería": None, "varones o mujeres": None}
    assert {k: N.generic_actor(k) for k in want} == want
    assert N.person_tokens("Juan de la Cruz") == ["juan", "de", "la", "cruz"] and N.person_tokens("Ministerio de Salud") is None and N.person_tokens("juan Pérez") is None


@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_similarity(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert N.lcs(a, b) == table[-1][-1] == N.lcs(b, a)
    assert N.score(a, a) == 100


def test_aliases_and_statistics(spark):
    registry = spark.createDataFrame([("0", "Lima", "LOC")], "id string, canonical_name string, category string")
    m = spark.createDataFrame([("d", i, t, "LOC") for i, t in enumerate(("Lima", "LIMA", "Limaa", "Cusco"))], "document_id string, mention_index int, text string, category string")
    r = R.resolve(m, registry, spark.createDataFrame([], "canonical_id string, normalized_alias string"))
    new = R.new_aliases(r, spark.createDataFrame([("0", "limaa")], "canonical_id string, normalized_alias string"))
    assert {(x["alias_text"], x["normalized_alias"]) for x in new.collect()} >= {("Lima", "lima"), ("Cusco", "cusco")}
    stats = {x["match_type"]: x["mentions"] for x in R.statistics(r).collect()}
    assert len(stats) == 7 and stats["exact"] == 2 and stats["morphology"] == 0
    assert R.registered(r, registry).count() == 1 + stats["new"]


def entities(spark):
    rows = [(i, t, "CHAR", 10 * i, 10 * i + len(t), f"s-{i // 3}", "ctx", "low") for i, t in enumerate(("mineros", "minero", "Griselda", FULL, "mineras", "minera"))]
    return spark.createDataFrame(rows, "mention_index int, text string, category string, start int, end int, sentence_id string, context string, ambiguity string")


def test_audit(spark, tmp_path):
    e = entities(spark)
    stored = e.selectExpr("'00000000-0000-0000-0000-000000000001' as document_id", "sentence_id", "concat('o', mention_index) as canonical_id", "text as canonical_name", "category", "text", "start", "end", "context", "ambiguity", "string(mention_index) as mention_id")
    registry = spark.createDataFrame([("o3", FULL, "CHAR")], "id string, canonical_name string, category string")
    about = jobs.export_audit(e, stored, registry, spark.createDataFrame([], "canonical_id string, normalized_alias string"), "00000000-0000-0000-0000-000000000001", str(tmp_path))
    assert about["mentions"] == 6 and about["statistics"]["morphology"] == 2 and about["before"]["nodes"] == 6 and about["after"]["nodes"] == 3
    assert (tmp_path / "convergences.csv").read_text().count("\n") == 4 and (tmp_path / "decisions_fuzzy.csv").read_text() == ""


def test_alignment_pairs_duplicates(spark):
    e = spark.createDataFrame([(i, "x", "CHAR", 0, 1, "s", None, None) for i in range(3)], entities(spark).schema)
    stored = e.selectExpr("*", "concat('c', mention_index) as canonical_id", "'n' as canonical_name", "string(mention_index) as mention_id")
    assert sorted(r["old_canonical_id"] for r in A.aligned(e, stored).collect()) == ["c0", "c1", "c2"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    e = {"text": "Lima", "category": "LOC", "start": 0, "end": 4, "sentence_id": "s-0", "context": "x", "ambiguity": "low"}
    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps({"document_id": f"d{k}", "entities": [e | {"text": t} for t in ("Lima", "LIMA")]}))
        incremental.resolve_stream(incremental.arriving_mentions(spark, str(src)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out/mentions")
    assert kept.count() == 4 and kept.select("canonical_id").distinct().count() == 1 and "second_match_score" not in kept.columns
    assert {r["match_type"] for r in kept.where("document_id = 'd1'").collect()} == {"exact"}
    assert spark.read.parquet(f"{tmp_path}/out/canonicals").count() == 1 and spark.read.parquet(f"{tmp_path}/out/aliases").count() == 1
    # A document that comes again without mentions loses those it had.
    (src / "2.json").write_text(json.dumps({"document_id": "d0", "entities": []}))
    incremental.resolve_stream(incremental.arriving_mentions(spark, str(src)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r["document_id"] for r in spark.read.parquet(f"{tmp_path}/out/mentions").collect()} == {"d1"}


def test_broken_rows_are_refused(spark):
    known, none = spark.createDataFrame([("0", "Lima", "LOC")], "id string, canonical_name string, category string"), spark.createDataFrame([], "canonical_id string, normalized_alias string")
    for text, category, start, end in ((" ", "LOC", 0, 4), ("Lima", "TOWN", 0, 4), ("Lima", None, 0, 4), ("Lima", "LOC", 5, 4), ("Lima", "LOC", None, 4)):
        m = spark.createDataFrame([("d", 0, text, category, start, end)], "document_id string, mention_index int, text string, category string, start int, end int")
        with pytest.raises(rules.RuleError):
            R.resolve(m, known, none)
    files = spark.createDataFrame([("in/a.pdf", 3, None)], "path string, length long, modificationTime timestamp")
    assert lifecycle.ingested(files, 1, '{"a": 1}').count() == 1
    for metadata in ("[1]", "{", "1"):
        with pytest.raises(rules.RuleError):
            lifecycle.ingested(files, 1, metadata)
    with pytest.raises(rules.RuleError):
        lifecycle.ingested(files.withColumn("path", F.lit("in/")), 1)


def corpus(spark, folder, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_families_of_all_documents(spark, tmp_path):
    d = corpus(spark, tmp_path, {1: "Ana Gómez", 2: "Juan Pérez", 3: "Eva Díaz"})
    got = {(r["document_id"], r["key"], r["root"]) for r in catalog.queries()["name_prefix_families"](spark, d).collect()}
    assert got == {("1", "ana gomez", "ana gomez"), ("1", "ana gomez vargas", "ana gomez"), ("2", "juan perez", "juan perez"), ("2", "juan perez vargas", "juan perez")}


def test_fuzzy_scores_every_category(spark):
    got = {(r["category"], r["comparison_key"]) for r in catalog.queries()["resolve_fuzzy_top2"](spark, "/root/testdata/sf0.001").collect()}
    plans = catalog.queries()["resolve_plans"](spark, "/root/testdata/sf0.001").where("strategy != 'generic_actor'").select("comparison_key").distinct().collect()
    assert {c for c, _ in got} == {"CHAR", "PRAC", "INFRA", "GOV", "LOC"} and {k for _, k in got} == {r[0] for r in plans}


def test_phrases_of_whole_texts(spark, tmp_path):
    d = corpus(spark, tmp_path, {1: "uno dos\ntres", 2: "ayer vino, Juan Pérez", 3: "- uno\tdos", 4: "solo", 5: None})
    rows = {q: catalog.queries()[q](spark, d).collect() for q in ("generic_singular", "person_tokens", "name_prefix_families")}
    want = [(1, 0, "Uno Dos"), (1, 1, "Dos Tres"), (2, 0, "ayer vino"), (2, 1, "vino Juan"), (2, 2, "Juan Pérez"), (3, 0, "mineros uno"), (3, 1, "mineros dos"), (4, 0, "Solo"), (5, 0, "")]
    for q in ("generic_singular", "person_tokens"):
        assert sorted((r["doc_id"], r["position"], r["phrase"]) for r in rows[q]) == want
    assert {r["generic"] for r in rows["generic_singular"] if r["doc_id"] == 3} == {"minero uno", "minero dos"}
    assert {r["tokens"] for r in rows["person_tokens"] if r["doc_id"] == 2 and r["tokens"]} == {"juan perez"}
    assert ("2", "juan perez vargas", "juan perez") in {(r["document_id"], r["key"], r["root"]) for r in rows["name_prefix_families"]}


def test_families_as_told_one_by_one(spark, tmp_path):
    """Words, not phrases, are looked at, and rows are dealt out once; families are those that plain Python finds."""
    odd = ["juan", "Pérez", "Vargas", "de", "La", "y", "ÑANDÚ", "ﬁn", "İstanbul", "ŉa", "ǅemal", "ΟΔΟΣ", "Jean-Luc", "Ana", "Aͺb", "Aﷺ", "B", "ΐota", "mineros", "Gobierno", "2nd"]
    r = random.Random(5)
    d = corpus(spark, tmp_path, {i: " ".join(r.choices(odd, k=r.choice([0, 1, 1, 2, 3, 40]))) for i in range(-9, 300)} | {400: None})
    times = Counter()
    for doc, phrase in registry_queries._phrases(spark, d).select((F.col("doc_id") % 20).cast("string"), "phrase").collect():
        for name in (phrase, f"{phrase} Vargas"):
            if N.significant(N.person_tokens(name) or []) >= 2:
                times[doc, N.normalize(name)] += 1
    starts = lambda key: (" ".join(key.split(" ")[: i + 1]) for i in range(key.count(" ") + 1))
    df = catalog.queries()["name_prefix_families"](spark, d)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, df.collect())) == sorted((doc, key, next(s for s in starts(key) if (doc, s) in times), n) for (doc, key), n in times.items())
