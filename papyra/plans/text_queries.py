"""Queries of cleaning, segmentation and annotation over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import fixed as X
from papyra.functions.markdown import markdown_to_text as to_text
from papyra.operators import annotations as A
from papyra.operators import cleaning as C
from papyra.operators import segments as G
from papyra.plans import views as V
from papyra.plans.registry import query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_LINES = f"""l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line, {_strip('s[i]')} AS st, lower({_strip('s[i]')}) AS key
 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))"""
_BACK = "SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id) k USING (doc_id)"


def _docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text")


@query(r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words FROM documents")
def clean_metrics(spark, d):
    m = C.metrics("text")
    return _docs(spark, d).select("doc_id", m["lines"].cast("long").alias("lines"), m["words"].cast("long").alias("words"))


@query(rf"""WITH {_LINES}, f AS (SELECT *, regexp_matches(key, '^\s*\d{{1,4}}\s*\.?\s*$') AS num, key <> '' AND NOT ends_with(key, '.') AND len(regexp_extract_all(key, '\S+')) <= 5 AS sh,
 key <> '' AND regexp_replace(st, '[^a-zA-ZÁÉÍÓÚÑáéíóúñ]', '', 'g') <> '' AND regexp_replace(st, '[^a-zA-ZÁÉÍÓÚÑáéíóúñ]', '', 'g') = upper(regexp_replace(st, '[^a-zA-ZÁÉÍÓÚÑáéíóúñ]', '', 'g')) AS up, regexp_replace(key, '^\d+\s+', '') AS bare FROM l),
c AS (SELECT *, count(*) FILTER (sh) OVER (PARTITION BY doc_id, key) >= 3 AS rs, count(*) FILTER (up) OVER (PARTITION BY doc_id, key) >= 3 AS ru FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM c WHERE NOT num),
s AS (SELECT doc_id, key AS bare, pos AS noted FROM n WHERE ru AND nth = 1),
kept AS (SELECT n.* FROM n LEFT JOIN s USING (doc_id, bare) WHERE NOT ((rs OR ru) AND nth > 1) AND NOT coalesce(noted <= pos, false)) {_BACK}""")
def line_recurring_headers(spark, d):
    return C.without_recurring(_docs(spark, d))


@query(f"""WITH {_LINES}, f AS (SELECT *, contains(line, '|') AS pipe FROM l),
g AS (SELECT *, last_value(CASE WHEN pipe OR st <> '' THEN pipe END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f),
kept AS (SELECT * FROM g WHERE NOT pipe AND NOT (st = '' AND coalesce(last, false))) {_BACK}""")
def line_strip_tables(spark, d):
    return C.without_tables(_docs(spark, d))


_NAMES = r"""(len(regexp_extract_all(st, '[\p{L}\p{M}\p{N}\p{Pc}]+')) >= 3 AND len(list_filter(regexp_extract_all(st, '[\p{L}\p{M}\p{N}\p{Pc}]+'), lambda w: regexp_full_match(w, '[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+'))) >= 3
 AND len(list_filter(regexp_extract_all(st, '[\p{L}\p{M}\p{N}\p{Pc}]+'), lambda w: regexp_full_match(w, '[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+'))) / len(regexp_extract_all(st, '[\p{L}\p{M}\p{N}\p{Pc}]+')) >= 0.5)"""
_TITLED = "len(list_filter({0}, lambda t: plain = t OR starts_with(plain, t || ' ') OR starts_with(plain, t || ':'))) > 0"
_MAIL = r"[\p{L}\p{M}\p{N}\p{Pc}.\-+]+@[\p{L}\p{M}\p{N}\p{Pc}.\-]+\.[\p{L}\p{M}\p{N}\p{Pc}]{2,}"


@query(rf"""WITH {_LINES}, a AS (SELECT *, regexp_replace(lower(st), ':+$', '') AS plain, coalesce(lag(st) OVER (PARTITION BY doc_id ORDER BY pos), '') AS before,
 list_filter(string_split_regex(translate(lower(st), ',.', '  '), '\s+'), lambda t: t <> '') AS tokens FROM l),
b AS (SELECT *, list_distinct(list_filter(tokens, lambda t: list_contains({_list(X.POSTAL)}, t) OR list_contains({_list(X.POSTAL)}, t || '.'))) AS hits, list_filter(tokens, lambda t: regexp_full_match(t, '\p{{Nd}}+')) AS nums FROM a),
e AS (SELECT *, CASE WHEN len(tokens) > 0 AND len(hits) >= 1 AND ((len(hits) >= 2 AND len(list_distinct(list_concat(hits, nums))) / len(tokens) >= 0.5) OR (regexp_matches(st, '\p{{Nd}}') AND (len(list_distinct(list_concat(hits, nums))) / len(tokens) >= 0.5 OR len(list_filter({_list(X.POSTAL)}, lambda p: starts_with(lower(st), p))) > 0))) THEN 'clears'
 WHEN len(regexp_extract_all(st, '\S+')) < 4 AND NOT ends_with(st, '.') THEN 'clears' ELSE 'kept' END AS other FROM b),
k AS (SELECT *, CASE WHEN st = '' THEN 'blank' WHEN regexp_matches(st, '^\s*\d{{1,4}}\s*\.?\s*$') THEN 'clears' WHEN {_TITLED.format(_list(X.SECTION_TITLES))} THEN 'sets' WHEN {_TITLED.format(_list(X.AUTHOR_HEADERS))} THEN 'sets'
 WHEN regexp_matches(st, '(?i)^(anexo|annex)\s+[IVXivx0-9]+') THEN 'clears' WHEN len(list_filter({_list(X.EDITORIAL)}, lambda p: starts_with(lower(st), p))) > 0 THEN 'sets' WHEN regexp_matches(st, '(?i)reproduccion|reproducción|derechos reservados') THEN 'sets'
 WHEN regexp_matches(st, '(?i)^\s*\|+.*[IVXivx0-9]+[\.:\|].*\d+\s*\|*\s*$') THEN 'clears' WHEN regexp_matches(st, '(?i)©\s*.+\s*/\s*') THEN 'sets'
 WHEN contains(st, '©') OR len(regexp_extract_all(st, '{_MAIL}')) >= 2 OR len(list_distinct(list_filter(regexp_extract_all(lower(st), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'), lambda w: list_contains({_list(X.INSTITUTIONS)}, w)))) >= 2
 OR (len(list_filter({_list(X.AUTHOR_HEADERS)}, lambda h: contains(lower(before), h))) > 0 AND {_NAMES}) THEN 'sets' WHEN {_NAMES} THEN 'names' ELSE other END AS kind FROM e),
g AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'sets' THEN true WHEN kind IN ('clears', 'kept') THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS flag FROM k),
kept AS (SELECT * FROM g WHERE kind IN ('blank', 'kept') OR (kind = 'names' AND NOT flag AND other = 'kept')) {_BACK}""")
def line_noise_filter(spark, d):
    return C.without_noise(_docs(spark, d))


@query(rf"""WITH {_LINES}, kept AS (SELECT doc_id, pos, CASE WHEN st = '' THEN line ELSE regexp_replace(line, '^(?:[IVX]{{2,5}}\.|\d+(?:\.\d+)*\s*[\.\)\-]|[a-zA-Z]\)\s+)', '') END AS line FROM l
 WHERE st = '' OR NOT regexp_matches(st, '^\s*(?:\d+[\.\)]|[a-zA-Z][\.\)]|[-•◦○▪►])\s*$')) {_BACK}""")
def numbering_strip(spark, d):
    return C.without_numbering(_docs(spark, d))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def whitespace_normalize(spark, d):
    return _docs(spark, d).withColumn("text", C.tidy(F.col("text")))


@query(r"SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '<!-- Start of picture text -->' || coalesce(text, '') || '<!-- end of Picture text-->tail' ELSE text END, '(?is)<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->', '', 'g') AS text FROM documents")
def picture_block_strip(spark, d):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<!-- Start of picture text -->"), F.coalesce("text", F.lit("")), F.lit("<!-- end of Picture text-->tail"))).otherwise(F.col("text"))
    return _docs(spark, d).withColumn("text", C.without_pictures(marked))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '{_MAIL}', ' ', 'g'), '" + X.PHONE.replace("(?U)", "").replace(r"\d", "[0-9]") + r"', ' ', 'g') AS text FROM documents")
def contact_mail_phone(spark, d):
    """E-mail and telephone alone; the URL pattern looks behind, which SQL's patterns here can't."""
    t = F.regexp_replace(F.regexp_replace("text", X.EMAIL, " "), X.PHONE, " ")
    return _docs(spark, d).withColumn("text", t)


@query()
def contact_scrub(spark, d):
    return _docs(spark, d).withColumn("text", C.without_contacts(F.col("text")))


_PARAGRAPHS = r"""d AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i, s[i] AS p FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM d)),
v AS (SELECT doc_id, i * 2 AS pos, p FROM u UNION ALL SELECT doc_id, i * 2 + 1, '  ' || p FROM u WHERE (i - 1) % 3 = 0)"""


@query(rf"""WITH {_PARAGRAPHS}, w AS (SELECT doc_id, pos, {_strip('p')} AS p FROM v), x AS (SELECT doc_id, pos, p, regexp_replace(lower(p), '\s+', ' ', 'g') AS n FROM w WHERE p <> ''),
y AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM x)
SELECT d.doc_id, coalesce(t, '') AS text FROM d LEFT JOIN (SELECT doc_id, string_agg(p, E'\n\n' ORDER BY pos) AS t FROM y WHERE b IS NULL OR b <> n GROUP BY doc_id) USING (doc_id)""")
def paragraph_dedup(spark, d):
    return C.without_repeated_paragraphs(V.paragraphs(spark, d).where("text is not null"))


@query(rf"""WITH RECURSIVE {_PARAGRAPHS}, q AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM v WHERE {_strip('p')} <> ''),
z AS (SELECT doc_id, string_agg(p, E'\n\n' ORDER BY pos) AS t FROM v GROUP BY doc_id),
k AS (SELECT doc_id, r, p, 0 AS c, length(p) + 2 AS size FROM q WHERE r = 1
 UNION ALL SELECT q.doc_id, q.r, q.p, CASE WHEN k.size + length(q.p) + 2 > 2000 THEN k.c + 1 ELSE k.c END, CASE WHEN k.size + length(q.p) + 2 > 2000 THEN length(q.p) + 2 ELSE k.size + length(q.p) + 2 END FROM k JOIN q ON q.doc_id = k.doc_id AND q.r = k.r + 1)
SELECT k.doc_id, CAST(c AS INTEGER) AS n, string_agg(p, E'\n\n' ORDER BY r) AS chunk FROM k JOIN z USING (doc_id) WHERE length(t) > 2000 GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, t FROM z WHERE length(t) <= 2000 AND doc_id IN (SELECT doc_id FROM q)""")
def paragraph_chunks(spark, d):
    return C.paragraph_chunks(V.paragraphs(spark, d), 2000)


@query()
def markdown_to_text(spark, d):
    return _docs(spark, d).withColumn("text", to_text("text"))


@query()
def structural_clean(spark, d):
    return C.structural_clean(_docs(spark, d))


_SENTENCES = r"""p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, n, s[2 * n + 1] AS piece, coalesce(s[2 * n + 2], '') AS sep, coalesce(s[2 * n + 3], '') AS nxt FROM (SELECT doc_id, s, unnest(range(0, (len(s) - 1) // 2 + 1)) AS n FROM p)),
r AS (SELECT *, sep <> '' AND (contains(sep, E'\n\n') OR (NOT (list_contains(""" + _list(X.ABBREVIATIONS) + r""", lower(regexp_extract(piece, '(\S+)\s*$', 1))) OR regexp_full_match(lower(regexp_extract(piece, '(\S+)\s*$', 1)), '[a-záéíóúñ]\.'))
 AND NOT regexp_full_match(regexp_extract(nxt, '^\s*(\S)', 1), '\p{Ll}'))) AS ends FROM q),
t AS (SELECT *, coalesce(sum(length(piece) + length(sep)) OVER w, 0) AS pos0, coalesce(count(*) FILTER (ends) OVER w, 0) AS seg FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT doc_id, seg, min(pos0) AS pos0, string_agg(piece || CASE WHEN ends THEN '' ELSE sep END, '' ORDER BY n) AS raw FROM t GROUP BY 1, 2),
sentence AS (SELECT doc_id, CAST(pos0 + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS INTEGER) AS start, """ + _strip("raw") + r""" AS text FROM g WHERE """ + _strip("raw") + """ <> '')"""


@query(f"WITH {_SENTENCES} SELECT doc_id, 's-' || lpad(CAST(start AS VARCHAR), 9, '0') AS sentence_id, start, text FROM sentence")
def sentence_segments(spark, d):
    return G.sentences(_docs(spark, d))


@query(rf"WITH {_SENTENCES} SELECT doc_id, count(*) AS sentences, max(length(text)) AS longest, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM sentence GROUP BY doc_id")
def sentence_stats(spark, d):
    s = G.sentences(_docs(spark, d))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("words"))


@query(rf"""WITH RECURSIVE {_PARAGRAPHS}, z AS (SELECT doc_id, string_agg(p, E'\n\n' ORDER BY pos) AS t FROM v GROUP BY doc_id),
o AS (SELECT doc_id, pos, p, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM v),
q AS (SELECT doc_id, off + length(p) - length(regexp_replace(p, '^\s+', '')) AS a, off + length(p) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM o WHERE {_strip('p')} <> ''),
k AS (SELECT doc_id, r, a, b, 1 AS n, 0 AS c FROM q WHERE r = 1
 UNION ALL SELECT q.doc_id, q.r, CASE WHEN q.b - k.a > 4000 OR k.n >= 3 THEN q.a ELSE k.a END, q.b, CASE WHEN q.b - k.a > 4000 OR k.n >= 3 THEN 1 ELSE k.n + 1 END, CASE WHEN q.b - k.a > 4000 OR k.n >= 3 THEN k.c + 1 ELSE k.c END FROM k JOIN q ON q.doc_id = k.doc_id AND q.r = k.r + 1),
s AS (SELECT doc_id, c AS n, min(a) AS a, max(b) AS b FROM k GROUP BY 1, 2)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(a AS INTEGER) AS start, substr(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS chunk FROM s JOIN z USING (doc_id)
UNION ALL SELECT doc_id, 0, 0, t FROM z WHERE doc_id NOT IN (SELECT doc_id FROM q)""")
def annotator_chunks(spark, d):
    return G.chunks(V.paragraphs(spark, d), 4000)


def _annotations(spark, d):
    """A gazetteer as annotator: in each sentence its first word twice, its last, and faults of every kind."""
    s = G.sentences(_docs(spark, d))
    w = s.withColumn("w", F.split("text", r"\s+"))
    first, last = F.col("w")[0], F.element_at("w", -1)
    note = lambda i, label, text, ambiguity, sid="sentence_id": F.struct(F.lit(i).alias("arrival"), F.lit(label).alias("label"), text.alias("text"), F.col(sid).alias("sentence_id") if sid == "sentence_id" else F.lit(sid).alias("sentence_id"), F.lit(ambiguity).cast("string").alias("ambiguity"))
    notes = F.array(note(0, "CHAR", first, "low"), note(1, "LOC", F.concat(F.lit(" "), last), None), note(2, "NONE", first, "low"), note(3, "GOV", F.lit("  "), "low"), note(4, "PRAC", first, "strange"), note(5, "INFRA", F.lit("@absent@"), "medium"), note(6, "CHAR", first, "low", "s-x"))
    return w.select("doc_id", F.explode(notes).alias("a")).select("doc_id", "a.*"), s


@query(rf"""WITH {_SENTENCES}, w AS (SELECT *, 's-' || lpad(CAST(start AS VARCHAR), 9, '0') AS sentence_id, string_split_regex(text, '\s+') AS w FROM sentence)
SELECT doc_id, 0 AS arrival, 'CHAR' AS label, w[1] AS span, sentence_id, 'low' AS ambiguity, start AS "at", text AS context FROM w UNION ALL SELECT doc_id, 1, 'LOC', w[-1], sentence_id, 'low', start, text FROM w
UNION ALL SELECT doc_id, 4, 'PRAC', w[1], sentence_id, 'high', start, text FROM w UNION ALL SELECT doc_id, 5, 'INFRA', '@absent@', sentence_id, 'medium', start, text FROM w""")
def annotation_validate(spark, d):
    a, s = _annotations(spark, d)
    return A.validated(a, s).select("doc_id", "arrival", "label", "span", "sentence_id", "ambiguity", "at", "context")


_ALIGNED = rf"""WITH {_SENTENCES}, w AS (SELECT *, 's-' || lpad(CAST(start AS VARCHAR), 9, '0') AS sentence_id, string_split_regex(text, '\s+') AS w FROM sentence),
ends AS (SELECT doc_id, sentence_id, start, text, w[1] AS one, w[-1] AS last, length(w[1]) AS n1, length(w[-1]) AS nl FROM w),
second AS (SELECT *, list_filter(range(n1, length(text) - nl + 1), lambda p: substr(text, p + 1, nl) = last)[1] AS pl FROM ends),
third AS (SELECT *, list_filter(range(n1, length(text) - n1 + 1), lambda p: substr(text, p + 1, n1) = one AND (pl IS NULL OR p + n1 <= pl OR p >= pl + nl))[1] AS p2 FROM second),
placed AS (SELECT doc_id, one AS text, 'CHAR' AS category, start, n1 AS n, 0 AS p, sentence_id, text AS context, 'low' AS ambiguity, 0 AS arrival FROM third
 UNION ALL SELECT doc_id, last, 'LOC', start, nl, pl, sentence_id, text, 'low', 1 FROM third WHERE pl IS NOT NULL UNION ALL SELECT doc_id, one, 'PRAC', start, n1, p2, sentence_id, text, 'high', 4 FROM third WHERE p2 IS NOT NULL)
SELECT doc_id, text, category, CAST(start + p AS INTEGER) AS start, CAST(start + p + n AS INTEGER) AS "end", sentence_id, context, ambiguity, arrival FROM placed"""


@query(_ALIGNED)
def annotation_align(spark, d):
    a, s = _annotations(spark, d)
    return A.aligned(a, s)


@query(_ALIGNED)
def annotation_merge(spark, d):
    a, s = _annotations(spark, d)
    e = A.aligned(a, s).withColumn("chunk", F.lit(0))
    return A.merged(e.union(e.withColumn("chunk", F.lit(1)))).drop("chunk")


@query(f"""WITH {_SENTENCES} SELECT doc_id, CAST(to_json({{'document_id': CAST(doc_id AS VARCHAR), 'document_title': '', 'section_title': '',
 'sentences': list({{'sentence_id': 's-' || lpad(CAST(start AS VARCHAR), 9, '0'), 'text': text}} ORDER BY start)}}) AS VARCHAR) AS request FROM sentence GROUP BY doc_id""")
def annotation_requests(spark, d):
    return A.requests(G.sentences(_docs(spark, d)))


@query("""SELECT 'span' AS rule, CAST(item_id AS VARCHAR) AS key FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 'label', CAST(item_id AS VARCHAR) FROM benchmark WHERE item_id % 5 = 0
UNION ALL SELECT 'ambiguity', CAST(item_id AS VARCHAR) FROM benchmark WHERE item_id % 7 = 0""")
def fewshot_check(spark, d):
    """Worked examples with planted faults, from the benchmark's texts."""
    b = V.table(spark, d, "benchmark")
    pick = lambda n, bad, good: F.when(F.col("item_id") % n == 0, bad).otherwise(good)
    note = F.struct(pick(5, F.lit("NONE"), F.lit("CHAR")).alias("label"), pick(3, F.lit("@@"), F.substring("text", 1, 5)).alias("text"), pick(7, F.lit("none"), F.lit("low")).alias("ambiguity"))
    return A.few_shot_rules(b.select(F.col("item_id").cast("string").alias("id"), "text", F.array(note).alias("annotations")))
