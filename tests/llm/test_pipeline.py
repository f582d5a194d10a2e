"""The stages one by one on what the one before kept, and the queries by name."""

import hashlib

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from papyra.llm.queries import oracle_sql, piece_model, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_names():
    assert [k.split("_")[0] for k in queries()] and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries()}
    assert set(oracle_sql()) <= set(queries()) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mixture", "tokens"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "tokens":
            assert out.columns == docs.columns
        if name in ("quality", "near_copies"):
            assert out.join(docs, docs.columns, "left_semi").count() == out.count() < docs.count()
        if name == "quality":
            good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id")
            assert good.join(out, "doc_id", "left_semi").count() >= 0.95 * good.count()
        if name == "tokens":
            want = {r["doc_id"]: hashlib.sha256(" ".join(map(str, sp.encode(r["text"], add_eos=True))).encode()).hexdigest() for r in docs.collect()}
            assert {r["doc_id"]: r["ids_sha256"] for r in out.collect()} == want
        docs = out


def test_stages_against_plain_python(spark, docs, rows, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names: each stage's rows by the brute-force versions of the operators' tests."""
    from test_nearcopies import brute
    from test_repeats import brute_bytes

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    named = docs.withColumn("_h", F.lit("x")).withColumn("row", F.lit("x")).withColumn("in", F.lit("x"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, named, str(tmp_path))
    assert good.columns == named.columns and good.count() == len(rows)  # without labels nothing is rejected
    single = stages["near_copies"](spark, good, str(tmp_path))
    classes = {c for _, c in brute(rows)}
    kept = [(r["doc_id"], r["text"], r["source"]) for r in single.collect()]
    assert {d for d, _, _ in kept} == classes and single.columns == named.columns
    cut = stages["repeats"](spark, single, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), len((r["text"] or "").encode())) for r in cut) == sorted((str(d), n - gone) for d, n, gone, _, _ in brute_bytes(kept))
    assert {r[c] for r in cut for c in ("_h", "row", "in")} == {"x"}


def test_nothing(spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = nothing
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert out.collect() == []


def test_batches_are_small(spark, nothing, tmp_path):
    """Each stage bounds the bytes that a Python worker gets at once, whatever the length of the texts."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    size = lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, nothing, str(tmp_path))
        got = [r["n"] for r in spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 20000) t").mapInArrow(size, "n long").collect()]
        assert sum(got) > 20_000_000 and max(got) < 5_000_000


def test_run(spark):
    r = corpus_pipeline.run(spark, SF)
    assert r.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and r.count() > 100
