"""Sentences and annotator chunks with exact code-point offsets.

A text is taken apart into (piece, separator) pairs by extraction; offsets are
running sums of their lengths, never positions inside a regular expression, which
would count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import fixed as X
from papyra.functions.text import casefold, strip

MAX_CHARS, MAX_PARAGRAPHS = 12_000, 3
_SEPARATOR = r"(?U)(?<=[.!?])\s+|\n{2,}"
#: Marks where the text may be cut; the character is a noncharacter, which texts don't hold.
_CUT = "﷐"


def sentence_id(start: Column) -> Column:
    return F.format_string("s-%09d", start)


def is_boundary(before: Column, separator: Column, after: Column) -> Column:
    """Whether a separator ends a sentence, given the text before and after it."""
    # Read from the end: the greedy start leaves only the last token to try.
    token = casefold(F.regexp_extract(before, r"(?sU)^.*(?<!\S)(\S+)\s*$", 1))
    short = token.isin(*X.ABBREVIATIONS) | token.rlike(r"^[a-záéíóúñ]\.$")
    lower = F.regexp_extract(after, r"(?U)^\s*(\S)", 1).rlike(r"^\p{IsLowercase}$")
    return F.contains(separator, F.lit("\n\n")) | (~short & ~lower)


def _pieces(docs: DataFrame, key: str) -> DataFrame:
    """Pieces with the separator after each: key, n, piece, sep, next."""
    marked = F.regexp_replace("text", f"({_SEPARATOR})", f"{_CUT}$1{_CUT}")
    parts = docs.where("text is not null").select(key, F.split(marked, _CUT, -1).alias("parts"))
    n = F.floor((F.size("parts") - 1) / 2).cast("int")
    at = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(at(2 * i).alias("piece"), at(2 * i + 1).alias("sep"), at(2 * i + 2).alias("next")))
    return parts.select(key, F.posexplode(pieces).alias("n", "p")).select(key, "n", "p.*")


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sentence_id, start, text of every sentence; documents without any have no row.

    Segmenting a whole document equals segmenting its chunks, so chunks matter to
    the annotator only.
    """
    order = Window.partitionBy(key).orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    p = _pieces(docs, key)
    end = F.when(F.col("sep") == "", False).otherwise(is_boundary(F.col("piece"), F.col("sep"), F.col("next")))
    p = p.withColumn("_end", end).withColumn("_at", F.coalesce(F.sum(F.length("piece") + F.length("sep")).over(before), F.lit(0)))
    p = p.withColumn("_segment", F.coalesce(F.count_if("_end").over(before), F.lit(0)))
    whole = F.array_sort(F.collect_list(F.struct("n", F.concat("piece", F.when(F.col("_end"), "").otherwise(F.col("sep"))).alias("t"))))
    s = p.groupBy(key, "_segment").agg(F.array_join(F.transform(whole, lambda x: x["t"]), "").alias("raw"), F.min("_at").alias("_at"))
    s = s.withColumn("text", strip("raw")).where("text != ''")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    s = s.withColumn("start", (F.col("_at") + lead).cast("int"))
    return s.select(key, sentence_id(F.col("start")).alias("sentence_id"), "start", "text")


def chunks(docs: DataFrame, max_chars: int = MAX_CHARS, max_paragraphs: int = MAX_PARAGRAPHS, key: str = "doc_id") -> DataFrame:
    """key, n (from 0), start, chunk: consecutive paragraphs spanning at most max_chars and max_paragraphs; a text without a paragraph is one chunk."""
    cut = F.split(F.regexp_replace("text", r"(\n{2,})", f"{_CUT}$1{_CUT}"), _CUT, -1)
    kind = "struct<done:array<struct<a:int,b:int>>,a:int,b:int,n:int,at:int>"
    zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("n"), F.lit(0).alias("at")).cast(kind)

    def add(s: Column, part: Column) -> Column:
        # A paragraph runs from its first character that isn't white space to the break.
        a = s["at"] + F.length(part) - F.length(F.regexp_replace(part, r"(?U)^\s+", ""))
        b = s["at"] + F.length(part)
        empty, opens = a >= b, s["a"] < 0
        full = ~opens & ((b - s["a"] > max_chars) | (s["n"] >= max_paragraphs))
        done = F.when(~empty & full, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["done"])
        new = ~empty & (opens | full)
        return F.struct(done.alias("done"), F.when(new, a).otherwise(s["a"]).alias("a"), F.when(~empty, b).otherwise(s["b"]).alias("b"), F.when(new, 1).otherwise(s["n"] + F.when(empty, 0).otherwise(1)).alias("n"), b.alias("at")).cast(kind)

    def finish(s: Column) -> Column:
        return F.when(s["a"] < 0, F.array(F.struct(F.lit(0).alias("a"), s["at"].alias("b")))).otherwise(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

    found = docs.where("text is not null").select(key, "text", F.aggregate(cut, zero, add, finish).alias("spans"))
    rows = found.select(key, "text", F.posexplode("spans").alias("n", "s"))
    return rows.select(key, "n", F.col("s.a").alias("start"), F.substring("text", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("chunk"))
