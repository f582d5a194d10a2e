"""What a name is for comparing: its normal form, generic actor, person tokens, and similarity.

Spark has no Unicode normal forms, so one vectorised function computes all of it
in a pass; callers run it on distinct strings.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions import fixed as X

_fold = {ord(d): "-" for d in X.DASHES} | {ord(q): p for q, p in X.QUOTES.items()}
_dashes = {ord(d): "-" for d in X.DASHES}
_word = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
_odd = re.compile(r"\d|[,;:()&/@]")
#: Endings: suffix, least length of the word, how many letters go, what comes instead.
_ENDINGS = (("iones", 7, 5, "ión"), ("ces", 5, 3, "z"), ("antes", 6, 1, ""), ("entes", 6, 1, ""), ("es", 5, 2, ""))
MOST_TOKENS = 6


def canonical(text: str) -> str:
    """White space collapsed."""
    return " ".join(re.sub(r"\s+", " ", text).strip().split(" "))


@lru_cache(65_536)
def normalize(text: str) -> str:
    """Compatibility form, plain dashes and quotes, no accents, single spaces, folded case."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).translate(_fold))
    return canonical("".join(c for c in plain if not unicodedata.combining(c))).casefold()


def singular(word: str) -> str:
    w = unicodedata.normalize("NFKC", word).casefold()
    if w in X.IRREGULAR or len(w) <= 3:
        return X.IRREGULAR.get(w, w)
    for suffix, least, gone, instead in _ENDINGS:
        if w.endswith(suffix) and len(w) >= least:
            return w[: len(w) - gone] + instead
    return w[:-1] if w[-1] == "s" and w[-2] in "aeiouáéíóú" else w


def _plain_words(text: str) -> list[str] | None:
    """The words of a name made of letters only, or None."""
    name = canonical(text)
    words = name.translate(_dashes).split()
    return words if words and not _odd.search(name) and all(map(_word.fullmatch, words)) else None


def generic_actor(text: str) -> str | None:
    """The singular of a generic actor such as a plural noun with its adjectives, or None if it isn't surely one."""
    words = _plain_words(text)
    if words is None or (not canonical(text).isupper() and any(w[0].isupper() for w in words[1:])):
        return None
    norm = [normalize(w) for w in words]
    if set(norm) & {*X.ACTOR_BLOCKERS, *X.CONNECTORS}:
        return None
    low = [w.casefold() for w in words]
    head = singular(low[0])
    if normalize(head) not in X.ACTOR_HEADS:
        return None
    end = next((i for i, n in enumerate(norm) if i and n in X.INFLECTION_ENDS), len(low))
    return " ".join([head, *map(singular, low[1:end]), *low[end:]])


def person_tokens(text: str) -> list[str] | None:
    """Normal forms of the words of a person's name, or None if it can't be one."""
    words = _plain_words(text)
    if words is None or len(words) > MOST_TOKENS:
        return None
    pairs = [(w, normalize(w)) for w in words]
    own = [(w, n) for w, n in pairs if n not in X.PARTICLES]
    if not own or any(not w[0].isupper() or n in X.PERSON_BLOCKERS for w, n in own):
        return None
    return [n for _, n in pairs]


def person_word(word: str) -> str | None:
    """The normal form of a word that a person's name may hold, or None: up to six such words, not all of them particles, are a name."""
    if word.isascii() and word.isalpha():  # most words, and their normal form is this
        n = word.lower()
    else:
        words = _plain_words(word)
        if words is None or len(words) != 1:
            return None
        n = normalize(word := words[0])
    return n if n in X.PARTICLES or (word[0].isupper() and n not in X.PERSON_BLOCKERS) else None


def significant(tokens) -> int:
    return sum(t not in X.PARTICLES for t in tokens)


def accents(text: str) -> int:
    return sum(unicodedata.normalize("NFD", c) != c for c in text)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all rows of the table in one integer's bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def score(a: str, b: str) -> float:
    """The better of the similarity as written and with words sorted."""
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


#: Types as objects: workers import this module, and have no session to parse their names.
FEATURES = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("generic", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("significant", T.IntegerType()), T.StructField("accents", T.IntegerType())])


@F.pandas_udf(FEATURES)
def _features(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        tokens = person_tokens(t) if t is not None else None
        rows.append((None, None, None, None, None) if t is None else (normalize(t), generic_actor(t), tokens, None if tokens is None else significant(tokens), accents(t)))
    return pd.DataFrame(rows, columns=["normalized", "generic", "tokens", "significant", "accents"])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """score of two columns."""
    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else normalize(t) for t in text], dtype=object)


@F.arrow_udf(T.ArrayType(T.StringType()))
def person_words(words: pa.Array) -> pa.Array:
    """person_word of each word of lists without nulls, computed once for each distinct word of a batch."""
    known = words.flatten().dictionary_encode()
    normal = pa.array([person_word(w) for w in known.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.list_value_length(words).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), normal.take(known.indices))


def with_features(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Adds normalized, generic, tokens, significant and accents of a column, computed once for each distinct string."""
    names = FEATURES.names
    known = df.select(F.col(column).alias("_t")).distinct().withColumn("_f", _features("_t")).select("_t", *(F.col(f"_f.{n}").alias(prefix + n) for n in names))
    return df.join(known, F.col(column).eqNullSafe(F.col("_t")), "left").drop("_t")


def best_first(preferred: Column, name: str = "canonical_name", accent: str = "accents", id_: str = "id") -> list[Column]:
    """The order in which equal candidates are preferred."""
    from papyra.functions.text import casefold

    return [F.desc(F.col(name) == preferred), F.desc(casefold(name) == casefold(preferred)), F.desc(accent), F.length(name), F.desc(id_)]
