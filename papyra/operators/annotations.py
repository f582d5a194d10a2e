"""Annotations of sentences: requests, validation, alignment to offsets, merging, and worked examples.

The annotator itself is outside: a function from a request (JSON) to annotations.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from papyra import schemas as S
from papyra.functions.text import strip
from papyra.operators import segments
from papyra.plans.durable import checkpointed

ANNOTATION = "array<struct<label:string,text:string,sentence_id:string,ambiguity:string>>"
#: The shape of an annotator's answer.
TOOL_SCHEMA = {
    "type": "object",
    "properties": {
        "document_id": {"type": "string"},
        "annotations": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {"label": {"type": "string", "enum": list(S.CATEGORIES)}, "text": {"type": "string"}, "sentence_id": {"type": "string"}, "ambiguity": {"type": "string", "enum": list(S.AMBIGUITIES)}},
                "required": ["label", "text", "sentence_id", "ambiguity"],
            },
        },
    },
    "required": ["document_id", "annotations"],
}


def requests(sentences: DataFrame, key: str = "doc_id", title: Column | None = None, section: Column | None = None, document: Column | None = None) -> DataFrame:
    """key, request: a JSON object with the document (the key, where not given) and its sentences in order."""
    listed = F.array_sort(F.collect_list(F.struct("start", "sentence_id", "text")))
    g = sentences.groupBy(key).agg(listed.alias("s"))
    bare = F.transform("s", lambda x: F.struct(x["sentence_id"].alias("sentence_id"), x["text"].alias("text")))
    return g.select(key, F.to_json(F.struct((document if document is not None else F.col(key)).cast("string").alias("document_id"), (title if title is not None else F.lit("")).alias("document_title"), (section if section is not None else F.lit("")).alias("section_title"), bare.alias("sentences"))).alias("request"))


def annotate(request_rows: DataFrame, annotator: Callable[[str], list[dict]], key: str = "doc_id") -> DataFrame:
    """key, arrival, label, text, sentence_id, ambiguity, error: the annotator's answers; a failure is a row with its message."""
    import json

    def ask(requests: pd.Series) -> pd.Series:
        out = []
        for r in requests:
            try:
                out.append(json.dumps({"a": annotator(r), "e": None}))
            except Exception as e:  # noqa: BLE001  what the outside raises is data here
                out.append(json.dumps({"a": [], "e": str(e)}))
        return pd.Series(out, dtype=object)

    said = request_rows.withColumn("_r", F.from_json(F.pandas_udf(ask, "string")("request"), f"struct<a:{ANNOTATION},e:string>"))
    rows = said.select(key, F.posexplode_outer("_r.a").alias("arrival", "_a"), F.col("_r.e").alias("error"))
    return rows.where("_a is not null or error is not null").select(key, "arrival", "_a.*", "error")


def validated(annotations: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Annotations with a known label, a span and a known sentence; spans stripped, ambiguity made one of three (absent: low, odd: high)."""
    a = annotations.where(F.col("label").isin(*S.CATEGORIES)).withColumn("span", strip("text")).where("span != ''")
    known = F.col("ambiguity").isin(*S.AMBIGUITIES)
    a = a.withColumn("ambiguity", F.when(F.col("ambiguity").isNull(), "low").when(known, F.col("ambiguity")).otherwise("high"))
    s = sentences.select(key, "sentence_id", F.col("start").alias("at"), F.col("text").alias("context"))
    return a.select(key, "arrival", "label", "span", "sentence_id", "ambiguity").join(s, [key, "sentence_id"])


def _find(sentence: str, span: str, taken: list[tuple[int, int]]) -> int:
    at = sentence.find(span)
    while at >= 0 and any(at < e and s < at + len(span) for s, e in taken):
        at = sentence.find(span, at + 1)
    return at


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(sentences: pd.Series, spans: pd.Series) -> pd.Series:
    """Where each span of a sentence goes, -1 for nowhere; Spark has no search from a place on."""
    out = []
    for sentence, wanted in zip(sentences, spans):
        taken, found = [], []
        for span in wanted:
            at = _find(sentence, span, taken)
            found.append(at)
            if at >= 0:
                taken.append((at, at + len(span)))
        out.append(found)
    return pd.Series(out, dtype=object)


def aligned(annotations: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities with offsets: in order of arrival each takes the first place of its span in its sentence that no earlier one overlaps; those without a place go."""
    v = validated(annotations, sentences, key)
    each = v.groupBy(key, "sentence_id", "at", "context").agg(F.array_sort(F.collect_list(F.struct("arrival", "label", "span", "ambiguity"))).alias("all"))
    placed = each.withColumn("_s", _places("context", F.transform("all", lambda a: a["span"])))
    rows = placed.select(key, "sentence_id", "at", "context", F.explode(F.arrays_zip("all", "_s")).alias("z")).where("z._s >= 0")
    start = F.col("at") + F.col("z._s")
    return rows.select(key, F.col("z.all.span").alias("text"), F.col("z.all.label").alias("category"), start.alias("start"), (start + F.length("z.all.span")).alias("end"), "sentence_id", "context", F.col("z.all.ambiguity").alias("ambiguity"), F.col("z.all.arrival").alias("arrival"))


def ordered(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    return entities.orderBy(key, "start", "end", "arrival")


def merged(entities: DataFrame, key: str = "doc_id", chunk: str = "chunk") -> DataFrame:
    """One entity for each start, end and category: the first by chunk, then by place and arrival."""
    w = Window.partitionBy(key, "start", "end", "category").orderBy(chunk, "start", "end", "arrival")
    return entities.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extracted(docs: DataFrame, annotator: Callable[[str], list[dict]], key: str = "doc_id", max_chars: int = segments.MAX_CHARS, max_paragraphs: int = segments.MAX_PARAGRAPHS) -> tuple[DataFrame, DataFrame]:
    """Entities of whole documents, and the chunks (key, chunk, error) that the annotator failed on.

    Each document is cut into chunks, each chunk's sentences are one request, and what
    comes back is validated against the sentences of that chunk, placed and merged.
    Offsets and sentence ids are those of the document. The annotator is asked once.
    A null or blank text has no request and no entity.
    """
    chunk = F.struct(F.col(key).alias("k"), F.col("n"), F.col("start").alias("at")).alias("_chunk")
    cut = segments.chunks(docs.select(key, "text"), max_chars, max_paragraphs, key).select(chunk, F.col("chunk").alias("text"))
    start = F.col("_chunk.at") + F.col("start")
    s = checkpointed(segments.sentences(cut, "_chunk").select("_chunk", segments.sentence_id(start).alias("sentence_id"), start.alias("start"), "text"))
    said = checkpointed(annotate(requests(s, "_chunk", document=F.col("_chunk.k")), annotator, "_chunk"))
    placed = aligned(said, s, "_chunk")
    whole = placed.select(F.col("_chunk.k").alias(key), F.col("_chunk.n").alias("chunk"), *(c for c in placed.columns if c != "_chunk"))
    failed = said.where("error is not null").select(F.col("_chunk.k").alias(key), F.col("_chunk.n").alias("chunk"), "error")
    return merged(whole, key), failed


def few_shot_rules(examples: DataFrame) -> DataFrame:
    """Violations of worked examples (id, text, annotations): rule, key."""
    a = examples.select("id", "text", F.explode("annotations").alias("a"))
    no = lambda d, rule, when: d.where(F.coalesce(when, F.lit(True))).select(F.lit(rule).alias("rule"), F.col("id").alias("key"))
    out = no(examples, "text", strip("text") == "").union(no(examples, "annotations", F.col("annotations").isNull()))
    out = out.union(no(a, "label", ~F.col("a.label").isin(*S.CATEGORIES))).union(no(a, "span", ~F.contains("text", "a.text")))
    return out.union(no(a, "ambiguity", ~F.col("a.ambiguity").isin(*S.AMBIGUITIES)))


def demonstrations(examples: DataFrame) -> DataFrame:
    """id, demonstration: each worked example as the JSON of a request and its answer."""
    sid = F.concat("id", F.lit("-s1"))
    notes = F.transform("annotations", lambda a: F.struct(a["label"].alias("label"), a["text"].alias("text"), sid.alias("sentence_id"), a["ambiguity"].alias("ambiguity")))
    asked = F.struct(F.col("id").alias("document_id"), F.lit("").alias("document_title"), F.lit("").alias("section_title"), F.array(F.struct(sid.alias("sentence_id"), F.col("text").alias("text"))).alias("sentences"))
    return examples.select("id", F.to_json(F.struct(F.col("id").alias("id"), asked.alias("input"), F.struct(F.col("id").alias("document_id"), notes.alias("annotations")).alias("expected_output"))).alias("demonstration"))
