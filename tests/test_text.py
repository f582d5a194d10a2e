"""Cleaning, segmentation, annotations and the life cycle."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.operators import annotations as A
from papyra.operators import cleaning as C
from papyra.operators import lifecycle as L
from papyra.operators import segments as G


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def run(step, spark, *texts):
    return [r["text"] for r in step(docs(spark, *texts)).orderBy("doc_id").collect()]


def test_recurring_headers(spark):
    t = "Capítulo\nuno dos\nCapítulo\n12\nHEADER LINE\nx y\nHEADER LINE\n3 header line\nCapítulo\nHeader Line\nHEADER LINE\nend"
    assert run(C.without_recurring, spark, t, None, "", "7") == ["Capítulo\nuno dos\nx y\nend", None, "", ""]
    # A number hides a key that hasn't been seen.
    assert run(C.without_recurring, spark, "1 TOP\nTOP\nTOP\nTOP\n2 TOP") == ["1 TOP"]


def test_tables(spark):
    assert run(C.without_tables, spark, "a\n|x|y|\n\n \nb\n\nc", "|", "\n\n|") == ["a\nb\n\nc", "", "\n"]


@pytest.mark.parametrize(
    ("line", "stays"),
    [
        ("123.", False), ("Resumen de la obra que se presenta hoy", False), ("Elaborado por: Juan", False), ("Anexo IV de los mapas", False), ("Publicado por la editorial en el año pasado", False),
        ("Esto incluye derechos reservados de todos", False), ("Foto de © Alguien / Agencia", False), ("a@b.pe y c@d.pe son los correos", False), ("El instituto y la universidad trabajan juntos hoy", False),
        ("Jr. Lima 123", False), ("tres palabras solas", False), ("Termina con punto.", True), ("Una oración normal que se queda aquí", True), ("María López Juan Pérez Quispe", True), ("", True),
    ],
)
def test_noise_lines(spark, line, stays):
    assert run(C.without_noise, spark, "zona previa de texto que queda\n" + line)[0].endswith("\n" + line) == stays


def test_names_after_a_header_go(spark):
    t = "Autores:\nMaría López Juan Pérez Quispe\nRosa Díaz Luis Soto Mamani\n\nAna Ruiz Pedro Paz Flores\nLa comunidad vive cerca del río grande.\nAna Ruiz Pedro Paz Flores"
    assert run(C.without_noise, spark, t) == ["\nLa comunidad vive cerca del río grande.\nAna Ruiz Pedro Paz Flores"]


def test_contacts_numbering_space(spark):
    c = docs(spark, "Escriba a x.y@z.com o vea https://a.b/c?d y www.q.pe, tel. 987 654 321 fin; sitio.org/x", None)
    got = [r[0] for r in c.select(C.without_contacts(F.col("text"))).collect()]
    assert "@" not in got[0] and "http" not in got[0] and "654" not in got[0] and "sitio" not in got[0] and got[1] is None
    assert run(C.without_numbering, spark, "1.2. Título\n- \n3)\na) cosa\nIV. Parte\n  \nI. x") == ["Título".join([" ", ""]) + "\ncosa\n Parte\n  \nI. x"]
    assert [r[0] for r in docs(spark, " a\n\n\n\nb \t c ").select(C.tidy(F.col("text"))).collect()] == ["a\n\nb c"]
    assert [r[0] for r in docs(spark, "a<!-- Start of picture text -->\nx<!-- END of picture text -->b").select(C.without_pictures("text")).collect()] == ["ab"]


def test_paragraphs(spark):
    assert run(C.without_repeated_paragraphs, spark, "A b\n\n a  B \n\n\n\nc\n\nA b", None, " ") == ["A b\n\nc\n\nA b", None, ""]
    got = C.paragraph_chunks(docs(spark, "aaaa\n\nbbbb\n\ncccccccccccccccc\n\nd", "short", " \n\n "), 13).orderBy("doc_id", "n").collect()
    assert [tuple(r) for r in got] == [(0, 0, "aaaa\n\nbbbb"), (0, 1, "cccccccccccccccc"), (0, 2, "d"), (1, 0, "short")]


def test_markdown_and_chain(spark):
    from papyra.functions.markdown import markdown_to_text

    md = "# Title #\n\nSome **bold** and *it* `code` [link](http://x) ![i](y)\n\n* item\n1. one\n> quote\n\n---\n```\nx = 1\n```\n&amp; \\*"
    got = docs(spark, md).select(markdown_to_text("text")).first()[0]
    assert got.strip() == "Title\nSome bold and it code link \nitem\none\nquote\nx = 1\n& *"
    out = run(C.structural_clean, spark, "# Informe\n\nLa comunidad **vive** cerca del río grande.\n\n|a|b|\n\n3\n", None, "", "Resumen")
    assert out == ["La comunidad vive cerca del río grande.", None, "", ""]
    assert [r["text"] for r in C.linguistic_clean(docs(spark, "a\n\nb"), lambda s: s.upper()).collect()] == ["A\n\nB"]


def plain_sentences(text):
    """The rule read line by line: boundaries in order, text between those that hold."""
    short = {"dr.", "dra.", "sr.", "sra.", "srta.", "ing.", "lic.", "etc.", "ej.", "p.", "pp.", "n.º", "n°."}
    out, at = [], 0
    ends = []
    for m in re.finditer(r"(?<=[.!?])\s+|\n{2,}", text):
        token = (text[: m.start()].split() or [""])[-1].lower()
        rest = text[m.end() :].lstrip()
        if "\n\n" in m[0] or not (token in short or re.fullmatch(r"[a-záéíóúñ]\.", token) or (rest and rest[0].islower())):
            ends.append((m.start(), m.end()))
    for a, b in [*ends, (len(text), len(text))]:
        raw = text[at:a]
        if raw.strip():
            out.append((at + len(raw) - len(raw.lstrip()), raw.strip()))
        at = b
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB.!? \nñÉ\U0001f600", max_size=40), min_size=30, max_size=30))
def test_sentences(spark, texts):
    texts = [*texts, "El Dr. Soto vino. Luego p. ej. fue a casa! y no volvió. Fin.\n\nOtra", "", "  "]
    got = {}
    for r in G.sentences(docs(spark, *texts)).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
        assert texts[r["doc_id"]][r["start"] : r["start"] + len(r["text"])] == r["text"] and r["sentence_id"] == f"s-{r['start']:09d}"
    assert got == {i: s for i, t in enumerate(texts) if (s := plain_sentences(t))}


def test_annotator_chunks(spark):
    t = "uno\n\n  dos\n\n\ntres\n\ncuatro\n\n" + "x" * 50 + "\n\nfin"
    got = [tuple(r) for r in G.chunks(docs(spark, t, "", "  "), 30).orderBy("doc_id", "n").select("doc_id", "start", "chunk").collect()]
    assert got == [(0, 0, "uno\n\n  dos\n\n\ntres"), (0, t.index("cuatro"), "cuatro"), (0, t.index("xx"), "x" * 50), (0, t.index("fin"), "fin"), (1, 0, ""), (2, 0, "  ")]


def annotated(spark, text, notes):
    s = G.sentences(docs(spark, text))
    ids = [r["sentence_id"] for r in s.orderBy("start").collect()]
    a = spark.createDataFrame([(0, k, label, span, ids[i] if isinstance(i, int) else i, amb) for k, (label, span, i, amb) in enumerate(notes)], "doc_id long, arrival int, label string, text string, sentence_id string, ambiguity string")
    return A.ordered(A.aligned(a, s)).collect()


def test_annotations(spark):
    text = "La minería afectó el río.\n\nLas comunidades rechazaron la minería."
    got = annotated(spark, text, [("PRAC", "minería", 1, "low"), ("LOC", "río", 0, "low"), ("PRAC", "minería", 0, None), ("CHAR", "comunidades", 1, "odd"), ("NO", "río", 0, "low"), ("LOC", " ", 0, "low"), ("LOC", "mar", 0, "low"), ("LOC", "río", "s-x", "low")])
    assert [r["text"] for r in got] == ["minería", "río", "comunidades", "minería"] and [r["ambiguity"] for r in got] == ["low", "low", "high", "low"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)
    assert [(r["start"], r["end"]) for r in annotated(spark, "minería y minería.", [("PRAC", "minería", 0, "low")] * 3)] == [(0, 7), (10, 17)]
    assert [(r["text"], r["start"]) for r in annotated(spark, "Minería y minería.", [("PRAC", "minería", 0, "low"), ("PRAC", "Minería", 0, "low")])] == [("Minería", 0), ("minería", 10)]


def test_annotator_interface(spark):
    s = G.sentences(docs(spark, "Lima crece. Cusco no.", "Falla aquí."))

    def annotator(request):
        r = json.loads(request)
        if r["document_id"] == "1":
            raise RuntimeError("cut off")
        return [{"label": "LOC", "text": x["text"].split()[0], "sentence_id": x["sentence_id"], "ambiguity": "low"} for x in r["sentences"]]

    said = A.annotate(A.requests(s), annotator)
    assert [r["error"] for r in said.where("error is not null").collect()] == ["cut off"]
    assert sorted(r["text"] for r in A.aligned(said.where("error is null"), s).collect()) == ["Cusco", "Lima"]
    e = spark.createDataFrame([("e1", "x y", [("CHAR", "x", "low")]), ("e2", "x", [("CHAR", "z", "no")])], "id string, text string, annotations array<struct<label:string,text:string,ambiguity:string>>")
    assert {tuple(r) for r in A.few_shot_rules(e).collect()} == {("span", "e2"), ("ambiguity", "e2")}
    assert json.loads(A.demonstrations(e).where("id = 'e1'").first()["demonstration"])["expected_output"]["annotations"][0]["sentence_id"] == "e1-s1"


def test_extraction_of_whole_documents(spark):
    texts = ("Lima crece. Cusco no.\n\n  Puno sí. Lima también.\n\nIca.", "Falla aquí.", None, " ", "Tacna.")

    def annotator(request):
        r = json.loads(request)
        if r["document_id"] == "1":
            raise RuntimeError("cut off")
        notes = [{"label": "LOC", "text": x["text"].split()[0].strip("."), "sentence_id": x["sentence_id"], "ambiguity": "low"} for x in r["sentences"]]
        return [*notes, {"label": "LOC", "text": "Lima", "sentence_id": "s-000000000", "ambiguity": "low"}]

    found, failed = A.extracted(docs(spark, *texts), annotator, max_paragraphs=1)
    rows = found.orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["chunk"], r["text"]) for r in rows] == [(0, 0, "Lima"), (0, 0, "Cusco"), (0, 1, "Puno"), (0, 1, "Lima"), (0, 2, "Ica"), (4, 0, "Tacna")]
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["text"] for r in rows)
    assert [tuple(r) for r in failed.collect()] == [(1, 0, "cut off")]


def test_lifecycle(spark):
    rows = [(str(i), f"{i}.pdf", f"f{i}", "pdf", 1, s, i % 8 + 1, "es", None, None, "c" if i > 0 else None, "t" if i > 1 else None, "n" if i > 2 else None, None) for i, s in enumerate(("raw", "converted", "cleaned", "ner", "fuzzyMatching"))]
    from papyra import schemas as S

    d = spark.createDataFrame(rows, S.DOCUMENT)
    ids = d.select("id").union(spark.createDataFrame([("x",)], "id string"))
    plan = L.reverted(d, ids)
    m = spark.createDataFrame([(str(i), i) for i in range(5)], "document_id string, n int")
    after, kept = L.apply_revert(d, m, plan)
    assert [r["status"] for r in after.orderBy("id").collect()] == ["raw", "raw", "converted", "cleaned", "ner"]
    assert {r["document_id"] for r in kept.collect()} == {"0", "1", "4"}
    assert {r["id"]: r["code"] for r in plan.collect()} == {"0": 409, "1": None, "2": None, "3": None, "4": None, "x": 404}
    work = lambda x: x.selectExpr("id", "upper(text) as output", "if(text = 'bad', 'no', null) as error")
    two = d.where("id = 1").union(d.where("id = 1").withColumn("id", F.lit("6"))).union(d.where("id = 1").withColumn("id", F.lit("7")))
    moved, done, errors = L.run_stage(two, "clean", spark.createDataFrame([("1", "t"), ("6", "bad")], "id string, text string"), work)
    assert {(r["id"], r["status"]) for r in moved.collect()} == {("1", "cleaned"), ("6", "converted"), ("7", "converted")}
    assert done.collect()[0]["output"] == "T" and {(r["id"], r["code"]) for r in errors.collect()} == {("6", 422), ("7", 500)}
    left, _, paths = L.removed(d, m, ids.where("id = '3'"))
    assert left.count() == 4 and {r["path"] for r in paths.collect()} == {"f3", "c", "t", "n"}
    with pytest.raises(ValueError):
        L.page(d, 0, 201)
    assert [r[0] for r in spark.createDataFrame([(" ES ",), ("x",), ("abcdefghijk",), (None,)], "l string").select(L.language_value("l")).collect()] == ["es", None, None, None]


def test_ingest(spark, tmp_path):
    from papyra.sources import readers

    (tmp_path / "A b.PDF").write_bytes(b"x")
    r = L.ingested(readers.blobs(spark, str(tmp_path)), 3, '{"a": 1}', "ES").first()
    assert (r["file_type"], r["file_size_bytes"], r["status"], r["incubator_number"], r["language"]) == ("pdf", 1, "raw", 3, "es")
    with pytest.raises(ValueError):
        L.ingested(readers.blobs(spark, str(tmp_path)), 9)
