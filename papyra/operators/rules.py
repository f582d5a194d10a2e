"""Checks as data: every rule yields rows (rule, key, message); an empty frame means all hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import schemas as S
from papyra.functions.text import strip

UUID = r"(?i)^\{?(?:urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


class RuleError(ValueError):
    """Raised by enforce with the first violations."""


def _broken(df: DataFrame, rule: str, key: Column, when: Column, message: str) -> DataFrame:
    return df.where(F.coalesce(when, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def blank(c: str) -> Column:
    return F.col(c).isNull() | (strip(c) == "")


def entity_rules(entities: DataFrame, key: str = "mention_index") -> DataFrame:
    """Before resolution: text, category and, where there are any, offsets (an empty span is allowed)."""
    k = F.col(key)
    text = [
        _broken(entities, "text", k, blank("text"), "blank text"),
        _broken(entities, "category", k, ~F.coalesce(F.col("category").isin(*S.CATEGORIES), F.lit(False)), "unknown category"),
    ]
    if not {"start", "end"} <= set(entities.columns):
        return _all(text)
    return _all([
        *text,
        _broken(entities, "offset_type", k, F.col("start").isNull() | F.col("end").isNull(), "offsets are not integers"),
        _broken(entities.where("start is not null and end is not null"), "offset_order", k, (F.col("start") < 0) | (F.col("end") < F.col("start")), "inconsistent offsets"),
    ])


def mention_rules(mentions: DataFrame) -> DataFrame:
    """Before a network: ids, name, category, a non-empty span, and one name and category for each canonical_id."""
    k = F.concat_ws("/", "document_id", "sentence_id", "canonical_id")
    missing = [_broken(mentions, c, k, F.coalesce(F.col(c), F.lit("")) == "", f"missing {c}") for c in ("document_id", "sentence_id", "canonical_id", "canonical_name")]
    two = mentions.groupBy("canonical_id").agg(F.count_distinct(F.struct("canonical_name", "category")).alias("n"))
    return _all([
        *missing,
        _broken(mentions, "category", k, ~F.col("category").isin(*S.CATEGORIES), "category not allowed"),
        _broken(mentions, "offsets", k, (F.col("start") < 0) | (F.col("end") <= F.col("start")), "invalid offsets"),
        _broken(two, "identity", F.col("canonical_id"), F.col("n") > 1, "one canonical_id with several names or categories"),
    ])


def context_rules(mentions: DataFrame) -> DataFrame:
    """A unit has at most one non-empty context."""
    units = mentions.groupBy("document_id", "sentence_id").agg(F.count_distinct(F.nullif("context", F.lit(""))).alias("n"))
    return _broken(units, "context", F.concat_ws("/", "document_id", "sentence_id"), F.col("n") > 1, "a unit with different contexts")


def join_rules(joined: DataFrame) -> DataFrame:
    """After joining mentions (category) and canonicals (canonical_category)."""
    k = F.concat_ws("/", "document_id", "sentence_id", "canonical_id")
    return _all([
        _broken(joined, "join_category", k, F.col("category") != F.col("canonical_category"), "category differs from the canonical's"),
        _broken(joined, "join_null", k, F.col("sentence_id").isNull() | F.col("start").isNull() | F.col("end").isNull(), "null id or offset"),
    ])


def network_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge tables that a core is cut from."""
    k, e = F.col("canonical_id"), F.concat_ws("/", "source_canonical_id", "target_canonical_id")
    twice = nodes.groupBy("canonical_id").count()
    pairs = edges.groupBy(F.least("source_canonical_id", "target_canonical_id").alias("a"), F.greatest("source_canonical_id", "target_canonical_id").alias("b")).count()
    ends = edges.select(F.explode(F.array("source_canonical_id", "target_canonical_id")).alias("canonical_id"))
    return _all([
        _broken(twice, "node_id", k, (F.coalesce(k, F.lit("")) == "") | (F.col("count") > 1), "missing or repeated canonical_id"),
        _broken(nodes, "node_category", k, ~F.col("category").isin(*S.CATEGORIES), "category not allowed"),
        _broken(nodes.where(F.col("category").isin(*S.CATEGORIES) & (F.coalesce("layer", F.lit("")) != "")), "node_layer", k, F.col("layer") != S.layer_of("category"), "layer doesn't fit the category"),
        _broken(edges, "self_loop", e, F.col("source_canonical_id") == F.col("target_canonical_id"), "self-loop"),
        _broken(ends.join(nodes.select("canonical_id"), "canonical_id", "left_anti"), "endpoint", k, F.lit(True), "unknown node"),
        _broken(pairs, "edge_twice", F.concat_ws("/", "a", "b"), F.col("count") > 1, "repeated edge"),
    ])


def integer_rules(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Text fields that are not whole numbers, by field."""
    return _all([_broken(df, f"integer:{f}", F.col(key), F.expr(f"try_cast(trim(`{f}`) as bigint)").isNull(), f"{f} is not an integer") for f in fields])


def document_id_rules(df: DataFrame, column: str = "document_id") -> DataFrame:
    """A document id is null or a UUID."""
    return _broken(df.where(F.col(column).isNotNull()), "uuid", F.col(column), ~F.col(column).rlike(UUID), "not a UUID")


def metadata_rules(documents: DataFrame) -> DataFrame:
    """Metadata parses to a JSON object; a file has a name."""
    parsed = F.expr("schema_of_variant(try_parse_json(metadata))")
    return _all([
        _broken(documents.where("metadata is not null"), "metadata", F.col("id"), F.coalesce(~parsed.startswith("OBJECT"), F.lit(True)), "metadata is not a JSON object"),
        _broken(documents, "filename", F.col("id"), F.coalesce(F.col("original_filename"), F.lit("")) == "", "no file name"),
    ])


def enforce(violations: DataFrame, show: int = 5) -> None:
    """Raises RuleError if there is any violation."""
    first = violations.limit(show).collect()
    if first:
        raise RuleError("; ".join(f"{r['rule']} [{r['key']}]: {r['message']}" for r in first))
