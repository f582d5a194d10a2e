"""Column expressions on strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Removes all Unicode white space from both ends (trim knows only the space)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def collapse(x) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def let(x, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(_c(x)), f), F.lit(0))


def holding(x: Column, parts) -> Column:
    """Those of the literal parts that stand somewhere in x."""
    return F.filter(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(x, p))


def words(x) -> Column:
    """The words between white space; none for blank text."""
    return F.filter(F.split(_c(x), r"(?U)\s+"), lambda w: w != "")


def casefold(x) -> Column:
    """Lower case for comparing: like lower, and the letters whose folded form differs from it."""
    folded = F.lower(_c(x))
    for a, b in (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return folded


def distinct_sorted(x) -> Column:
    """Distinct non-empty strings of an aggregated column, by folded form and then as they are."""
    pairs = F.transform(F.filter(F.collect_set(_c(x)), lambda v: v != ""), lambda v: F.struct(casefold(v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])
