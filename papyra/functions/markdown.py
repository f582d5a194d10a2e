"""Markdown to plain text by regular expressions over whole texts; blocks stay on lines of their own.

A small CommonMark reader: fences, headings, rules, quotes, list marks, HTML,
links, images, emphasis, code spans, escapes and entities. Blank lines between
blocks become one line end, as a rendered page's text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (what a text must hold for the pattern to match, or None; pattern; replacement), in order.
RULES = (
    ("\r", r"\r\n?", "\n"),
    (None, r"(?m)^ {0,3}(?:```|~~~).*\n?", ""),
    ("<!--", r"(?s)<!--.*?-->", ""),
    ("#", r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", "$1"),
    (None, r"(?m)^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$\n?", ""),
    ("=", r"(?m)^ {0,3}=+[ \t]*$\n?", ""),
    (">", r"(?m)^(?: {0,3}>[ \t]?)+", ""),
    (None, r"(?m)^[ \t]*(?:[-+*]|\d{1,9}[.)])[ \t]+", ""),
    ("]:", r"(?m)^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*\n?", ""),
    ("![", r"!\[([^\]\n]*)\]\([^)\n]*\)", ""),
    ("](", r"\[([^\]\n]+)\]\([^)\n]*\)", "$1"),
    ("<", r"<((?:https?|ftp|mailto):[^>\s]+)>", "$1"),
    ("<", r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>", ""),
    ("`", r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", "$2"),
    (None, r"(?<!\\)(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"),
    ("*", r"(?<![\\*])\*(?=[^\s*])([^*\n]+?)(?<=\S)\*(?!\*)", "$1"),
    ("_", r"(?U)(?<![\\\w])_(?=[^\s_])([^_\n]+?)(?<=\S)_(?!\w)", "$1"),
    (None, r"(?m)(?: {2,}|\\)$", ""),
    ("\\", r"""\\([!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])""", "$1"),
    (None, r"\n(?:[ \t]*\n)+", "\n"),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def _rule(needed: str | None, pattern: str, to: str) -> Callable[[Column], Column]:
    if needed is None:
        return lambda t: F.regexp_replace(t, pattern, to)
    return lambda t: F.when(F.contains(t, F.lit(needed)), F.regexp_replace(t, pattern, to)).otherwise(t)


def markdown_to_text(text) -> Column:
    """The text without its marks; each step is bound once, so that a look for what it needs spares most texts its pattern."""
    out = F.array(F.col(text) if isinstance(text, str) else text)
    for rule in RULES:
        out = F.transform(out, _rule(*rule))
    out = F.get(out, F.lit(0))
    for name, to in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(to))
    return out
