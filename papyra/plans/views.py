"""Adapters that give the engine's operators data from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category_of(key: str):
    return F.element_at(F.array(*(F.lit(c) for c in S.CATEGORIES)), (F.col(key) % 5 + 1).cast("int"))


def mentions(spark: SparkSession, sf_dir: str, node: str = "l_partkey") -> DataFrame:
    """Line items as mentions: an order is a sentence, a customer a document, a part (or a supplier) a canonical entity."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    start = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")) * 100
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    name = F.col("p_name") if node == "l_partkey" else F.concat(F.lit("Supplier "), F.col(node).cast("string"))
    j = j.withColumn("start", start.cast("int")).withColumn("name", name)
    ambiguity = F.create_map(F.lit("N"), F.lit("low"), F.lit("R"), F.lit("medium"), F.lit("A"), F.lit("high"))[F.col("l_returnflag")]
    return j.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("l_orderkey").cast("string").alias("sentence_id"), F.col(node).cast("string").alias("canonical_id"), F.col("name").alias("canonical_name"), category_of(node).alias("category"), F.col("name").alias("text"), "start", (F.col("start") + F.length("name")).alias("end"), F.lit(None).cast("string").alias("context"), ambiguity.alias("ambiguity"), F.concat_ws("-", "l_orderkey", "start").alias("mention_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as rows of the document life cycle."""
    d = table(spark, sf_dir, "documents")
    status = F.element_at(F.array(*(F.lit(s) for s in S.STATUSES)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = lambda ext: F.concat(F.lit("store/"), F.col("doc_id").cast("string"), F.lit(ext))
    rank = F.col("doc_id") % 5
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("original_filename"), path(".md").alias("file_path"), F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("docx").alias("file_type"), F.col("n_chars").cast("long").alias("file_size_bytes"), status.alias("status"), (F.col("doc_id") % 8 + 1).cast("short").alias("incubator_number"), F.col("lang").alias("language"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 10000 as int))").alias("uploaded_at"), F.concat(F.lit('{"source": "'), F.col("source"), F.lit('"}')).alias("metadata"), F.when(rank >= 1, path(".conv.md")).alias("converted_path"), F.when(rank >= 2, path(".txt")).alias("cleaned_path"), F.when(rank >= 3, path(".json")).alias("ner_path"), F.lit(None).cast("string").alias("images_path"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with paragraph breaks, which the corpus itself lacks: its line ends doubled, and every third paragraph said twice."""
    d = table(spark, sf_dir, "documents")
    twice = F.flatten(F.transform(F.split("text", "\n"), lambda p, i: F.when(i % 3 == 0, F.array(p, F.concat(F.lit("  "), p))).otherwise(F.array(p))))
    return d.select("doc_id", F.array_join(twice, "\n\n").alias("text"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entities: the least part of each name and category."""
    p = table(spark, sf_dir, "part")
    return p.withColumn("category", category_of("p_partkey")).groupBy("category", F.col("p_name").alias("canonical_name")).agg(F.min("p_partkey").cast("string").alias("id")).select("id", "canonical_name", "category")
