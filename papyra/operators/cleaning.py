"""Structural cleaning of converted documents, line by line and paragraph by paragraph.

Lines are rows of (doc, pos, line), and the rules are window expressions on them:
what looks like a state machine only ever needs the last line of some kind. A
document's lines meet in one task; documents never do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import fixed as X
from papyra.functions.markdown import markdown_to_text
from papyra.functions.text import collapse, holding, let, strip, words

#: A line of at most this many words is short; a line seen this often in a document recurs.
SHORT_WORDS, RECURS = 5, 3


def _set(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line: key, pos (from 0), line."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def joined(line_rows: DataFrame, key: str = "doc_id", by: str = "\n", line: str = "line") -> DataFrame:
    """Back to one text for each key, lines in order."""
    both = F.array_sort(F.collect_list(F.struct("pos", F.col(line).alias("line"))))
    return line_rows.groupBy(key).agg(F.array_join(F.transform(both, lambda r: r["line"]), by).alias("text"))


def _with_all(docs: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """A document that lost all its lines keeps an empty text."""
    return docs.select(key, F.col("text").isNull().alias("_null")).join(cleaned, key, "left").select(key, F.when(~F.col("_null"), F.coalesce("text", F.lit(""))).alias("text"))


def line_step(rule: Callable[[DataFrame, str], DataFrame]) -> Callable[..., DataFrame]:
    """A rule on lines as a step on documents."""

    def step(docs: DataFrame, key: str = "doc_id") -> DataFrame:
        return _with_all(docs, joined(rule(lines(docs, key), key), key), key)

    return step


def metrics(text: str) -> Column:
    """struct(lines, words)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.when(t == "", 0).otherwise(F.size(F.split(t, "\n", -1))).alias("lines"), F.size(words(t)).alias("words"))


def without_pictures(text) -> Column:
    return F.regexp_replace(text, X.PICTURE, "")


def is_upper(line: Column) -> Column:
    """It has letters, and none of them is small."""
    return line.rlike("[A-ZÁÉÍÓÚÑ]") & ~line.rlike("[a-záéíóúñ]")


def fewer_words(line: str | Column, n: int) -> Column:
    """Whether a stripped line has fewer than n words; the split stops at n."""
    return F.size(F.split(line, r"(?U)\s+", n)) < n


def recurring_rule(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops recurring headers and footers, and lone numbers.

    A recurring short line stays once; a recurring line that was in capitals goes
    wherever it stands, except where a number before it (`<digits> key`) hides a
    key that hasn't been seen yet.
    """
    by_key = Window.partitionBy(key, "_key")
    short = fewer_words("_key", SHORT_WORDS + 1) & ~F.col("_key").endswith(".") & (F.col("_key") != "")
    upper = is_upper(strip("line")) & (F.col("_key") != "")
    r = rows.withColumn("_key", F.lower(strip("line")))
    r = r.withColumn("_short", F.count_if(short).over(by_key) >= RECURS).withColumn("_upper", F.count_if(upper).over(by_key) >= RECURS)
    r = r.withColumn("_number", F.col("_key").rlike(X.ONLY_NUMBER)).withColumn("_bare", F.regexp_replace("_key", r"(?U)^\d+\s+", ""))
    # Numbers are dropped before anything is noted, so they don't count as seen.
    live = r.where(~F.col("_number"))
    first = F.row_number().over(Window.partitionBy(key, "_key").orderBy("pos")) == 1
    live = live.withColumn("_first", first)
    # The positions at which recurring capital keys are first noted: the least pos that isn't dropped as a repeated short line.
    noted = live.where("_upper and _first").select(key, F.col("_key").alias("_bare"), F.col("pos").alias("_noted"))
    live = live.join(noted, [key, "_bare"], "left")
    again = (F.col("_short") | F.col("_upper")) & ~F.col("_first")
    # A line whose bare key is a noted capital key goes; a first hit has just been noted itself.
    hidden = F.coalesce(F.col("_noted") <= F.col("pos"), F.lit(False))
    return live.where(~again & ~hidden).select(*rows.columns)


def table_rule(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops lines with a pipe and the blank lines right after them."""
    ordered = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pipe, blank = F.col("line").contains("|"), strip("line") == ""
    last = F.coalesce(F.last(F.when(pipe | ~blank, pipe), ignorenulls=True).over(ordered), F.lit(False))
    return rows.withColumn("_go", pipe | (blank & last)).where("not _go").drop("_go")


def without_contacts(text) -> Column:
    """E-mail addresses, then URLs, then telephone numbers become a space each."""
    mails = lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, X.EMAIL, " ")).otherwise(t)
    text = let(text, mails)
    for p in (X.URL, X.PHONE):
        text = F.regexp_replace(text, p, " ")
    return text


def name_list(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(r"(?U)\b\w+\b"))
    capital = F.regexp_count(line, F.lit(r"(?U)\b[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\b"))
    return (n >= 3) & (capital >= 3) & (F.try_divide(capital, n) >= 0.5)


def _any(values) -> str:
    return "(?:" + "|".join(re.escape(v) for v in sorted(values, key=len, reverse=True)) + ")"


def _titled(line: Column, titles) -> Column:
    """Equal to a title, or a title followed by a space or a colon."""
    return line.rlike(f"^{_any(titles)}(?:[ :]|$)")


def address(line: Column) -> Column:
    postal, plain = _set(X.POSTAL), _set(dict.fromkeys(p.rstrip(".") for p in X.POSTAL))

    def judged(tokens: Column, hits: Column) -> Column:
        numbers = F.filter(tokens, lambda t: t.rlike(r"^\p{Nd}+$"))
        begins, digit = F.lower(line).rlike("^" + _any(X.POSTAL)), line.rlike(r"\p{Nd}")
        decide = lambda ratio: ((F.size(hits) >= 2) & (ratio >= 0.5)) | (digit & ((ratio >= 0.5) | begins))
        return F.coalesce(let(F.try_divide(F.size(F.array_union(hits, numbers)), F.size(tokens)), decide), F.lit(False))

    def found(tokens: Column) -> Column:
        dotted = F.transform(F.array_intersect(F.transform(tokens, lambda t: F.concat(t, F.lit("."))), postal), lambda t: F.regexp_replace(t, r"\.$", ""))
        return F.array_union(F.array_intersect(tokens, postal), dotted)

    # Most lines have no such word, which one look tells.
    look = lambda tokens: F.when(F.arrays_overlap(tokens, plain), let(found(tokens), lambda hits: judged(tokens, hits))).otherwise(False)
    return let(words(F.translate(F.lower(line), ",.", "  ")), look)


def _author_line(line: Column, before: Column) -> Column:
    whole = lambda low: F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"((?U)\b{_any(X.INSTITUTIONS)}\b)"), 1)))
    two = let(F.lower(line), lambda low: F.when(F.size(holding(low, X.INSTITUTIONS)) >= 2, whole(low) >= 2).otherwise(False))
    header = let(F.lower(before), lambda low: F.size(holding(low, X.AUTHOR_HEADERS)) > 0)
    mails = F.when(line.contains("@"), F.regexp_count(line, F.lit(X.EMAIL))).otherwise(0)
    return line.contains("©") | (mails >= 2) | two | (header & name_list(line))


def noise_rule(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops noise lines: the first of twelve classes that fits decides, and names after a header go with it.

    Only a name list needs the flag that a header leaves; all other classes set
    or clear it whatever it was, so the flag before a line is the one left by the
    last line that isn't such a name list.
    """
    order = Window.partitionBy(key).orderBy("pos")
    r = rows.withColumn("_l", strip("line"))
    r = r.withColumn("_before", F.coalesce(F.lag("_l").over(order), F.lit("")))
    line, plain = F.col("_l"), F.regexp_replace(F.lower("_l"), ":+$", "")
    legal = line.rlike(X.LEGAL)
    editorial = F.lower(line).rlike("^" + _any(X.EDITORIAL))
    kind = (
        F.when(line == "", "blank").when(line.rlike(X.ONLY_NUMBER), "clears").when(_titled(plain, X.SECTION_TITLES), "sets").when(_titled(plain, X.AUTHOR_HEADERS), "sets")
        .when(line.rlike(X.ANNEX), "clears").when(editorial, "sets").when(legal, "sets").when(line.rlike(X.INDEX_ROW), "clears").when(line.rlike(X.PHOTO_CREDIT), "sets")
        .when(_author_line(line, F.col("_before")), "sets").when(name_list(line), "names")
    )
    other = F.when(fewer_words(line, 4) & ~line.endswith("."), "clears").when(address(line), "clears").otherwise("kept")
    r = r.withColumn("_kind", kind)
    r = r.withColumn("_else", F.when(F.col("_kind").isNull() | (F.col("_kind") == "names"), other)).withColumn("_kind", F.coalesce("_kind", "_else"))
    left = F.when(F.col("_kind") == "sets", True).when(F.col("_kind").isin("clears", "kept"), False)
    seen = F.coalesce(F.last(left, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    # A name list either carries the flag on or, without it, is judged as any line; then it clears a flag that is clear.
    r = r.withColumn("_flag", seen)
    keep = (F.col("_kind").isin("blank", "kept")) | ((F.col("_kind") == "names") & ~F.col("_flag") & (F.col("_else") == "kept"))
    return r.where(keep).select(*rows.columns)


def numbering_rule(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops lines that are only a bullet or an enumerator; strips section numbers."""
    l = strip("line")
    return rows.where((l == "") | ~l.rlike(X.ONLY_ITEM)).withColumn("line", F.when(l == "", F.col("line")).otherwise(F.regexp_replace("line", X.SECTION_NUMBER, "")))


without_recurring = line_step(recurring_rule)
without_tables = line_step(table_rule)
without_noise = line_step(noise_rule)
without_numbering = line_step(numbering_rule)


def paragraph_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = docs.where("text is not null").select(key, F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "p"))
    return rows.withColumn("p", strip("p")).where("p != ''")


def _unlike_before(rows: DataFrame, key: str) -> DataFrame:
    r = rows.withColumn("_n", collapse(F.lower("p")))
    return r.withColumn("_b", F.lag("_n").over(Window.partitionBy(key).orderBy("pos"))).where("_b is null or _b != _n")


def without_repeated_paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops blank paragraphs and any that says what the one before says, but for case and white space."""
    return _with_all(docs, joined(_unlike_before(paragraph_rows(docs, key), key), key, "\n\n", "p"), key)


def tidy(text) -> Column:
    """At most two newlines in a row, one blank, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def paragraph_chunks(docs: DataFrame, max_chars: int = 12_000, key: str = "doc_id") -> DataFrame:
    """Key, n (from 0), chunk: paragraphs packed to at most max_chars; a longer one is a chunk of its own; a text that fits is one chunk, a blank one none."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def add(s: Column, p: Column) -> Column:
        size = F.length(p) + 2
        full = (s["size"] + size > max_chars) & (F.size(s["open"]) > 0)
        done = F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, F.array(p)).otherwise(F.concat(s["open"], F.array(p))).alias("open"), F.when(full, size).otherwise(s["size"] + size).alias("size"))

    def finish(s: Column) -> Column:
        return F.transform(F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]), lambda c: F.array_join(c, "\n\n"))

    said = F.filter(F.split("text", "\n\n", -1), lambda p: strip(p) != "")
    packed = F.when((F.length("text") <= max_chars) & (F.size(said) > 0), F.array("text")).otherwise(F.aggregate(said, start, add, finish))
    return docs.where("text is not null").select(key, F.posexplode(packed).alias("n", "chunk"))


def identity_repair(text: Column) -> Column:
    return text


def structural_clean(docs: DataFrame, key: str = "doc_id", repair: Callable[[Column], Column] = identity_repair) -> DataFrame:
    """All ten steps in order; repair is the plug for a mojibake fixer.

    Rules on lines run one after the other on the same rows; texts are put
    together only where a step needs them whole, and documents that lost
    everything come back at the end.
    """
    rows = lines(docs.select(key, without_pictures(repair(F.col("text"))).alias("text")), key)
    plain = joined(table_rule(recurring_rule(rows, key), key), key).withColumn("text", without_contacts(markdown_to_text("text")))
    said = joined(numbering_rule(noise_rule(lines(plain, key), key), key), key)
    said = joined(_unlike_before(paragraph_rows(said, key), key), key, "\n\n", "p")
    return _with_all(docs, said.withColumn("text", tidy("text")), key)


def linguistic_clean(docs: DataFrame, clean: Callable | None = None, max_chars: int = 12_000, key: str = "doc_id") -> DataFrame:
    """Runs clean(chunk) -> chunk, an external editor, over packed paragraphs; empty answers are skipped, and a text with none stays."""
    if clean is None:
        return docs.select(key, "text")
    import pandas as pd

    edit = F.pandas_udf(lambda s: pd.Series([clean(x) or "" for x in s], dtype=object), "string")
    said = paragraph_chunks(docs, max_chars, key).withColumn("line", strip(edit("chunk"))).where("line != ''").withColumnRenamed("n", "pos")
    return docs.select(key, F.col("text").alias("_t")).join(joined(said, key, "\n\n"), key, "left").select(key, F.coalesce("text", "_t").alias("text"))
