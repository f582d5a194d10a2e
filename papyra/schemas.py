"""Record types and the small dimensions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories in display order, the layer of each, the groups of the block matrices and the twelve blocks.
CATEGORIES = ("CHAR", "PRAC", "INFRA", "GOV", "LOC")
LAYER_OF = {"CHAR": "CHAR", "PRAC": "L2", "INFRA": "L2", "GOV": "L2", "LOC": "LOC"}
LAYERS = ("CHAR", "L2", "LOC")
GROUPS = {"CHAR": ("CHAR",), "L2": ("PRAC", "INFRA", "GOV"), "LOC": ("LOC",), "PRAC": ("PRAC",), "INFRA": ("INFRA",), "GOV": ("GOV",)}
BLOCKS = (
    ("A_CHAR", "CHAR", "CHAR"),
    ("A_L2", "L2", "L2"),
    ("A_LOC", "LOC", "LOC"),
    ("B_CHAR__L2", "CHAR", "L2"),
    ("B_CHAR__LOC", "CHAR", "LOC"),
    ("B_L2__LOC", "L2", "LOC"),
    ("A_PRAC__PRAC", "PRAC", "PRAC"),
    ("B_PRAC__INFRA", "PRAC", "INFRA"),
    ("B_PRAC__GOV", "PRAC", "GOV"),
    ("A_INFRA__INFRA", "INFRA", "INFRA"),
    ("B_INFRA__GOV", "INFRA", "GOV"),
    ("A_GOV__GOV", "GOV", "GOV"),
)
AMBIGUITIES = ("low", "medium", "high")
STATUSES = ("raw", "converted", "cleaned", "ner", "fuzzyMatching")

MENTION = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("sentence_id", T.StringType()), T.StructField("canonical_id", T.StringType()),
    T.StructField("canonical_name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("context", T.StringType()),
    T.StructField("ambiguity", T.StringType()), T.StructField("mention_id", T.StringType()),
])
ENTITY = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("category", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("sentence_id", T.StringType()), T.StructField("context", T.StringType()), T.StructField("ambiguity", T.StringType()),
])
NER_FILE = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY))])
CANONICAL = T.StructType([T.StructField("id", T.StringType()), T.StructField("canonical_name", T.StringType()), T.StructField("category", T.StringType())])
ALIAS = T.StructType([
    T.StructField("canonical_id", T.StringType()), T.StructField("alias_text", T.StringType()), T.StructField("normalized_alias", T.StringType()),
    T.StructField("resolution_method", T.StringType()), T.StructField("source_document_id", T.StringType()),
])
DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("original_filename", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("file_type", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()), T.StructField("status", T.StringType()), T.StructField("incubator_number", T.ShortType()), T.StructField("language", T.StringType()),
    T.StructField("uploaded_at", T.TimestampNTZType()), T.StructField("metadata", T.StringType()), T.StructField("converted_path", T.StringType()),
    T.StructField("cleaned_path", T.StringType()), T.StructField("ner_path", T.StringType()), T.StructField("images_path", T.StringType()),
])
FEW_SHOT = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("examples", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ambiguity", T.StringType())]))),
    ]))),
])


def rank_of(value, order: tuple[str, ...]) -> Column:
    """Position of a value in a fixed order, null if it isn't there."""
    return F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(value) if isinstance(value, str) else value), F.lit(0).cast("long")).cast("int")


def layer_of(category) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    return F.create_map(*(F.lit(x) for kv in LAYER_OF.items() for x in kv))[c]


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BLOCKS), "matrix string, row_group string, column_group string")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, c) for g, cs in GROUPS.items() for c in cs], "group string, category string")
