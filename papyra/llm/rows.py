"""Rows carried whole, so that no column of the input can clash with those of an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole(docs: DataFrame) -> Column:
    """All columns of the row as one struct: `select("row.*")` gives them back."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")


def row_hash(docs: DataFrame) -> Column:
    """A hash of the row; maps, which have no order, are left out."""
    return F.xxhash64(*(F.col(quoted(f.name)) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def with_field(docs: DataFrame, name: str, value: Column) -> Column:
    """The struct `row` with one of its fields replaced, in the order of docs."""
    return F.struct(*(value.alias(c) if c == name else F.col("row")[c].alias(c) for c in docs.columns)).alias("row")


def text_struct(docs: DataFrame) -> str:
    """The type of the struct `row` of docs, with text as a string."""
    fields = docs.schema.fields
    return "struct<" + ", ".join(f"{quoted(f.name)}: {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in fields) + ">"
