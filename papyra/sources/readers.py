"""Where data comes from: files of documents, mentions, networks, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import schemas as S
from papyra.operators.rules import RuleError, document_id_rules, enforce, integer_rules

NATIVE_CHARS = 500


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole UTF-8 files."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def safe_name(path: Column) -> Column:
    """The last part of a path, whichever slash it uses."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(safe_name(path), r"(\.[^.]+)$", 1))


def ner_files(spark: SparkSession, path: str) -> DataFrame:
    """document_id, mention_index and fields of each entity of annotation files; raises if a file isn't an object with a UUID and a list of objects."""
    raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(T.StructType([*S.NER_FILE.fields, T.StructField("_bad", T.StringType())])).json(path)
    # Bad files are looked for in what was parsed, which must be kept to be asked twice.
    raw = raw.select(F.input_file_name().alias("_file"), "*").persist()
    try:
        bad = raw.where("_bad is not null or document_id is null or entities is null or exists(entities, e -> e is null)").select("_file").limit(3).collect()
        if bad:
            raise RuleError("not an object with document_id and a list of entities: " + ", ".join(r["_file"] for r in bad))
        enforce(document_id_rules(raw))
    finally:
        raw.unpersist()
    return raw.select("document_id", F.posexplode("entities").alias("mention_index", "e")).select("document_id", "mention_index", "e.*")


def csv(spark: SparkSession, path: str, integers: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """A CSV file with a header, all text but for the columns that must be integers; anything else there raises with the field's name."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    missing = [c for c in integers if c not in df.columns]
    if missing:
        raise RuleError(f"no column {', '.join(missing)} in {path}")
    if integers:
        enforce(integer_rules(df, list(integers), key or df.columns[0]))
    # A blank cell is an empty text, as it is in the file.
    return df.select(*(F.expr(f"cast(trim(`{c}`) as bigint)").alias(c) if c in integers else F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """A run's summary.json, with a text document_id."""
    df = spark.read.option("multiLine", "true").json(path)
    if "document_id" not in df.columns or dict(df.dtypes)["document_id"] != "string":
        raise RuleError("summary.json has no valid document_id")
    return df


NODE_INTEGERS = ("matrix_index", "mention_count", "sentence_count", "document_count", "ambiguity_low", "ambiguity_medium", "ambiguity_high", "ambiguity_other")
EDGE_INTEGERS = ("sentence_count", "document_count")


def stored_mentions(mentions: DataFrame, canonicals: DataFrame, document_id: str) -> DataFrame:
    """Mentions of one document with their canonical's name, in order of place and id."""
    c = canonicals.select(F.col("id").alias("canonical_id"), "canonical_name", F.col("category").alias("canonical_category"))
    m = mentions.where(F.col("document_id") == document_id).join(c, "canonical_id")
    return m.select("document_id", "sentence_id", "canonical_id", "canonical_name", "category", "text", "start", "end", "context", "ambiguity", "mention_id", "canonical_category").orderBy("start", "end", "mention_id")


def converted(files: DataFrame, native: Callable[[bytes, str], tuple[str, int]], ocr: Callable[[bytes], str]) -> DataFrame:
    """path, text, route, error of files by injected converters.

    native gives a text and how many stripped characters its pages hold; a PDF
    with at most NATIVE_CHARS of them goes to ocr. What fails is a row with its
    message.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    text, n = native(content, path)
                    scanned = path.lower().endswith(".pdf") and n <= NATIVE_CHARS
                    rows.append((path, ocr(content) if scanned else text, "ocr" if scanned else "native", None))
                except Exception as e:  # noqa: BLE001  what the outside raises is data here
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "route", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, route string, error string")
