"""URL filters as of the day of the fetch, against a plain reading of the rules."""

import datetime as dt
import re

import pytest

from papyra.llm import url_lists
from papyra.llm.url_lists import LIST, filter_urls

DAY = dt.date(2024, 1, 1)
URLS = (
    "http://example.org/a", "https://www.Example.org:8080/a?x=1#y", "https://user:pw@sub.example.org", "http://notexample.org/", "http://example.org.evil.com/", "https://tionsh.example.net/fr/1",
    "https://tionsh.example.net/french", "https://tionsh.example.net/fr", "http://m.tiontion.example.com/x", "https://ththon.example.com/en/11629/", "https://ththon.example.com/en/11629/a", "", None, "no url", "http:///x", "http://tionble.example.com.", "ftp://blog.tionble.example.com/x/y/z",
)


def brute(url, day, events):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    if not m or day is None:
        return set()
    host = re.sub(r"\.$", "", m[1].lower())
    path = re.match(r"[^:]+://[^/?#]*([^?#]*)", url)[1].lower().rstrip("/")
    active = {}
    for s, v, d, e in sorted((x for x in set(events) if None not in x), key=lambda x: (x[2], x[3])):
        if d <= str(day):
            active[s, v] = e == "add"
    hit = {"domain": lambda v: host == v or host.endswith("." + v), "host": lambda v: host == v, "url": lambda v: host + path == v, "prefix": lambda v: host + path == v or (host + path).startswith(v + "/")}
    return {f"{s}:{v}" for (s, v), on in active.items() if on and hit[s](v)}


@pytest.mark.parametrize("few", [100_000, 3])
def test_as_of(spark, monkeypatch, few):
    monkeypatch.setattr(url_lists, "FEW_ENTRIES", few)
    events = [*LIST, LIST[0], (None, "x", "2024-01-01", "add"), ("host", None, "2024-01-01", "add"), ("host", "tionsh.example.net", None, "add"), ("host", "tionsh.example.net", "2024-01-01", "odd")]
    rows = [(i, u, d, "x", "y") for i, (u, d) in enumerate((u, None if k < 0 else DAY + dt.timedelta(days=k)) for u in URLS for k in (-1, 0, 14, 40, 100, 121, 140, 152, 200, 258, 300, 365))]
    rows += rows[:5]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, key string, blocked string")
    got = filter_urls(captures, spark.createDataFrame(events, "scope string, value string, day string, event string")).collect()
    assert len(got) == len(rows)
    plain = [e for e in events if e[3] in ("add", "remove")]
    for r in got:
        want = brute(r["url"], r["fetched_on"], plain)
        assert (r["blocked"], r["n_entries"], r["entry"]) == (bool(want), len(want), min(want, default=None)), r
        assert r["key"] == "x"


def test_long_urls_and_clashing_names(spark):
    long = "http://" + "a." * 300 + "example.org/" + "b/" * 3000 + "?" + "c" * 10_000
    names = ["_n", "_e", "_u", "_d", "u", "d", "n", "e", "row", "key", "salt"]
    captures = spark.createDataFrame([(1, long, dt.date(2024, 2, 1), *["x"] * len(names))], "page_id long, url string, fetched_on date, " + ", ".join(f"{n} string" for n in names))
    r = filter_urls(captures, spark.createDataFrame(list(LIST), "scope string, value string, day string, event string")).collect()
    assert [(x["blocked"], x["entry"], x["url"]) for x in r] == [(True, "domain:example.org", long)] and {r[0][n] for n in names} == {"x"}


def test_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", DAY)], "page_id long, url string, fetched_on date")
    none = spark.createDataFrame([], "scope string, value string, day string, event string")
    assert [r["blocked"] for r in filter_urls(captures, none).collect()] == [False]
    assert filter_urls(captures.limit(0), none).collect() == []
