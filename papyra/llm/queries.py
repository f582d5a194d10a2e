"""One query per operator, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.graph_search import nearest
from papyra.llm.lm import lm_scores
from papyra.llm.mixing import mix_sources
from papyra.llm.nearcopies import near_copies
from papyra.llm.pieces import piece_digests
from papyra.llm.quality import quality_scores
from papyra.llm.subspaces import vector_copies
from papyra.llm.substrings import substring_dedup
from papyra.llm.suffixes import suffix_digests
from papyra.llm.url_lists import LIST, filter_urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model() -> str:
    """The vocabulary of the production runs; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents")).drop("text")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies(_read(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch day; one is derived from page_id, over a year."""
    captures = _read(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched_on"))
    events = spark.createDataFrame(list(LIST), "scope string, value string, day string, event string")
    return filter_urls(captures, events)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(_read(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_read(spark, sf_dir, "documents"), piece_model())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_read(spark, sf_dir, "documents")).drop("h")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i:i + 12], ' ') END AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first_doc FROM p WHERE win IS NOT NULL GROUP BY win),
g AS (SELECT p.doc_id, p.i, p.word, coalesce(f.first_doc < p.doc_id, false) AS hit FROM p LEFT JOIN f USING (win)),
c AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


def _op3_sql() -> str:
    events = ", ".join(f"('{s}', '{v}', DATE '{d}', '{e}')" for s, v, d, e in LIST)
    return rf"""
WITH e(scope, value, since, event) AS (VALUES {events}),
i AS (SELECT *, lead(since) OVER (PARTITION BY scope, value ORDER BY since, event) AS until FROM e),
a AS (SELECT scope, value, since, until FROM i WHERE event = 'add' AND (until IS NULL OR until > since)),
p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on,
      rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
      lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')) AS path FROM pages),
h AS (SELECT p.page_id, count(*) AS n, min(a.scope || ':' || a.value) AS entry FROM p JOIN a ON p.host <> '' AND p.fetched_on >= a.since AND (a.until IS NULL OR p.fetched_on < a.until)
      AND CASE a.scope WHEN 'host' THEN p.host = a.value WHEN 'domain' THEN p.host = a.value OR p.host LIKE '%.' || a.value
          WHEN 'url' THEN p.host || p.path = a.value ELSE p.host || p.path = a.value OR p.host || p.path LIKE a.value || '/%' END GROUP BY p.page_id)
SELECT p.page_id, p.url, p.fetched_on, h.n IS NOT NULL AS blocked, CAST(coalesce(h.n, 0) AS BIGINT) AS n_entries, h.entry FROM p LEFT JOIN h USING (page_id)
"""


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(hex(b[i:i + 199])) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w JOIN m USING (h)),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
u AS (SELECT r, g, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, g),
k AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM u GROUP BY r)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda j: hex(b[CASE WHEN j = 1 THEN 1 ELSE z[j - 1] END:CASE WHEN j > len(a) THEN octet_length(b) ELSE a[j] - 1 END])), '')) END) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op3_url_filter": _op3_sql(), "op4_suffix_dedup": OP4_SQL}
