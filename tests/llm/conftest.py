import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, slice string, score string, h string, at string, size string, node string"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Nulls, empty and long texts, ties, repeated rows, copies, shared passages; (doc_id, text, source)."""
    passage, base = " ".join(words(70, 1)), words(200, 2)
    near = base[:]
    near[100] = "changed"
    rows = [
        (None, None, None), (None, passage, "a"), (1, "", "a"), (2, None, "b"), (3, "  \n\t ", None), (4, "one two three", "a"), (5, "Ünïcode ▁ 日本語 　 x", "b"),
        (6, " ".join(base), "a"), (7, " ".join(near), "a"), (8, " ".join(base), "b"), (8, " ".join(base), "b"), (9, " ".join(words(120, 3)) + " " + passage, "c"),
        (10, passage + " " + " ".join(words(90, 4)), "c"), (11, " ".join(words(20000, 5)), "c"), (12, "x" * 5000, "a"), (13, "ab " * 400, "a"), (14, "ab " * 400 + "tail", "b"),
        (15, " ".join(words(300, 6)), None), (16, "A" * 199, "a"), (17, "B" * 200 + "\r\n" + "B" * 200, "a"), (18, "one two three", "a"),
    ]
    return rows + [(100 + i, " ".join(words(60, 50 + i)), f"s{i % 3}") for i in range(30)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "x", "x", "x", "x", "x", "x") for d, t, s in rows], DOC)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
