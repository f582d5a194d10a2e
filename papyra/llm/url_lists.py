"""URL filters as a temporal list join.

A list is a log of dated events: an entry (scope, value) is added or removed on a
day. Events become validity intervals [from, until), and every capture is judged
as of the day it was fetched: by the entries active then, not by today's list.

Scopes: `domain` matches a host and all hosts below it, `host` one host exactly,
`prefix` a host with a path down to a whole segment, `url` a host with its whole
path; query, fragment, user, port and case of the host play no part. Each distinct
capture is turned into the few keys that entries can have, so the join is an
equi-join on the key with a range condition on the day. A list of at most
FEW_ENTRIES intervals is broadcast; a longer one is joined by key with the
captures salted, as one host may hold a third of all pages.

Defined cases: a null, empty or hostless URL and a null day match nothing; a null
scope, value, day or event makes an event void; on one day a removal counts
after an addition; adding what is active changes nothing; repeated rows each get
the verdict; an empty list blocks nothing; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.rows import quoted, whole

FEW_ENTRIES = 100_000
SALTS = 16
#: The list of the production runs, in order of date: scope, value, day, event.
LIST = (
    ("domain", "example.org", "2024-01-15", "add"),
    ("host", "tionsh.example.net", "2024-02-01", "add"),
    ("prefix", "thering.example.org/de", "2024-02-10", "add"),
    ("domain", "tionble.example.com", "2024-03-01", "add"),
    ("host", "tionsh.example.net", "2024-04-01", "remove"),
    ("domain", "example.org", "2024-05-01", "remove"),
    ("prefix", "tionsh.example.net/fr", "2024-05-20", "add"),
    ("host", "m.tiontion.example.com", "2024-06-01", "add"),
    ("host", "m.tiontion.example.com", "2024-06-01", "remove"),
    ("domain", "tionble.example.com", "2024-07-04", "remove"),
    ("url", "ththon.example.com/en/11629", "2024-07-10", "add"),
    ("domain", "example.org", "2024-08-01", "add"),
    ("prefix", "tionsh.example.net/fr", "2024-09-15", "remove"),
    ("host", "tionsh.example.net", "2024-10-01", "add"),
    ("domain", "ththan.example.net", "2024-11-01", "add"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """key, scope, value, since, until (null: still active) of the entries."""
    e = events.select("scope", F.lower("value").alias("value"), F.col("day").cast("date").alias("since"), "event")
    e = e.where("scope is not null and value is not null and since is not null and event in ('add', 'remove')").distinct()
    w = Window.partitionBy("scope", "value").orderBy("since", "event")
    e = e.withColumn("until", F.lead("since").over(w)).where("event = 'add' and (until is null or until > since)")
    return e.select(F.concat_ws(":", "scope", "value").alias("key"), "scope", "value", "since", "until")


def keys(url: str = "url"):
    """All keys under which an entry can match a URL, as an array."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    path = F.lower(F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", ""))
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/")))
    all_ = F.concat(domains, F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("url:"), host, path)), prefixes)
    return F.when(host != "", F.array_distinct(all_))


def filter_urls(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """The captures with blocked, n_entries (active entries that match) and entry (the first of them by scope and value)."""
    spans = intervals(events).select("key", F.col("scope").alias("s"), F.col("value").alias("v"), "since", "until")
    rows = captures.select(whole(captures), F.col(quoted(url)).alias("u"), F.col(quoted(day)).cast("date").alias("d"))
    asked = rows.select("u", "d").where("u is not null and d is not null").distinct()
    asked = asked.select("u", "d", F.explode(keys("u")).alias("key"))
    on = ["key"]
    # One row more than may be broadcast is enough to know.
    if spans.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES:
        spans = F.broadcast(spans)
    else:
        spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked, on = asked.withColumn("salt", F.pmod(F.hash("u", "d"), F.lit(SALTS))), ["key", "salt"]
    hits = asked.join(spans, on).where("d >= since and (until is null or d < until)")
    said = hits.groupBy("u", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "v")).alias("e"))
    out = rows.join(said, ["u", "d"], "left")
    kept = [F.col("row")[c].alias(c) for c in captures.columns if c not in ("blocked", "n_entries", "entry")]
    entry = F.when(F.col("n").isNotNull(), F.concat_ws(":", "e.s", "e.v")).alias("entry")
    return out.select(*kept, F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), entry)
