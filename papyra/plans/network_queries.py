"""Queries of the co-occurrence network and its core."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import schemas as S
from papyra.operators import audit as A
from papyra.operators import cooccurrence as C
from papyra.operators import network as N
from papyra.operators import rules as R
from papyra.plans import views as V
from papyra.plans.durable import checkpointed
from papyra.plans.registry import query


def _mentions_sql(node: str = "l_partkey", name: str = "p_name") -> str:
    return f"""m AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, CAST(l_orderkey AS VARCHAR) AS sentence_id, CAST({node} AS VARCHAR) AS canonical_id,
 {name} AS canonical_name, ['CHAR','PRAC','INFRA','GOV','LOC'][{node} % 5 + 1] AS category, {node} % 5 AS rank, {name} AS text,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) * 100 AS INTEGER) AS start,
 CASE l_returnflag WHEN 'N' THEN 'low' WHEN 'R' THEN 'medium' WHEN 'A' THEN 'high' END AS ambiguity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
"""


_NODES = """n0 AS (SELECT canonical_id, max(canonical_name) AS canonical_name, max(category) AS category, max(rank) AS rank, count(*) AS mention_count,
 count(DISTINCT document_id || '/' || sentence_id) AS sentence_count, count(DISTINCT document_id) AS document_count,
 count(*) FILTER (ambiguity = 'low') AS ambiguity_low, count(*) FILTER (ambiguity = 'medium') AS ambiguity_medium, count(*) FILTER (ambiguity = 'high') AS ambiguity_high,
 count(*) FILTER (coalesce(ambiguity, '') NOT IN ('low', 'medium', 'high')) AS ambiguity_other FROM m GROUP BY canonical_id),
n AS (SELECT *, CASE category WHEN 'CHAR' THEN 'CHAR' WHEN 'LOC' THEN 'LOC' ELSE 'L2' END AS layer,
 CAST(row_number() OVER (ORDER BY rank, lower(canonical_name), canonical_id) - 1 AS BIGINT) AS matrix_index,
 CAST(row_number() OVER (PARTITION BY rank ORDER BY lower(canonical_name), canonical_id) - 1 AS BIGINT) AS category_index FROM n0),
"""
_EDGES = """u AS (SELECT DISTINCT document_id, sentence_id, m.canonical_id, matrix_index FROM m JOIN n USING (canonical_id)),
e AS (SELECT a.matrix_index AS source_index, b.matrix_index AS target_index, count(*) AS sentence_count, count(DISTINCT a.document_id) AS document_count
 FROM u a JOIN u b ON a.document_id = b.document_id AND a.sentence_id = b.sentence_id AND a.matrix_index < b.matrix_index GROUP BY 1, 2),
"""
_TABLE = """t AS (SELECT e.*, s.canonical_id AS source_canonical_id, d.canonical_id AS target_canonical_id, s.canonical_name AS source_name, d.canonical_name AS target_name,
 s.category AS source_category, d.category AS target_category, s.layer AS source_layer, d.layer AS target_layer,
 CASE WHEN s.rank <= d.rank THEN s.category || '--' || d.category ELSE d.category || '--' || s.category END AS category_pair,
 CASE WHEN list_position(['CHAR','L2','LOC'], s.layer) <= list_position(['CHAR','L2','LOC'], d.layer) THEN s.layer || '--' || d.layer ELSE d.layer || '--' || s.layer END AS layer_pair
 FROM e JOIN n s ON e.source_index = s.matrix_index JOIN n d ON e.target_index = d.matrix_index),
"""
_GROUPS = """g(grp, category) AS (VALUES ('CHAR','CHAR'),('L2','PRAC'),('L2','INFRA'),('L2','GOV'),('LOC','LOC'),('PRAC','PRAC'),('INFRA','INFRA'),('GOV','GOV')),
gm AS (SELECT grp, matrix_index, CAST(row_number() OVER (PARTITION BY grp ORDER BY matrix_index) - 1 AS BIGINT) AS block_index FROM n JOIN g USING (category)),
b(matrix, row_group, column_group) AS (VALUES """ + ", ".join(str(x) for x in S.BLOCKS) + """),
cells AS (SELECT b.matrix, r.block_index AS "row", c.block_index AS "column", w.v AS value FROM (SELECT source_index AS i, target_index AS j, sentence_count AS v FROM e UNION ALL SELECT target_index, source_index, sentence_count FROM e) w
 JOIN gm r ON w.i = r.matrix_index JOIN gm c ON w.j = c.matrix_index JOIN b ON b.row_group = r.grp AND b.column_group = c.grp),
"""
_M = _mentions_sql()
# A dense network for what needs heavy edges: suppliers as nodes.
_DENSE = _mentions_sql("l_suppkey", "'Supplier ' || l_suppkey")
_ALL = "WITH " + _M + _NODES + _EDGES
_HEAVY = 25


def _x(head: str, tail: str) -> str:
    return head.rstrip().rstrip(",") + "\n" + tail


def _m(spark, d):
    return V.mentions(spark, d)


def _network(spark, d):
    """Edges and nodes from one pass over the mentions."""
    m = _m(spark, d)
    once = C.units(m)
    return C.edges(m, once), C.nodes(m, once)


@query(_x("WITH " + _M + _NODES, "SELECT matrix_index, category_index, CAST(row_number() OVER (PARTITION BY layer ORDER BY matrix_index) - 1 AS BIGINT) AS layer_index, canonical_id, canonical_name, category, layer, mention_count, sentence_count, document_count, ambiguity_low, ambiguity_medium, ambiguity_high, ambiguity_other FROM n"))
def cooc_nodes(spark, d):
    return C.nodes(_m(spark, d))


@query(_x("WITH " + _M, "SELECT CAST(row_number() OVER (ORDER BY document_id, sentence_id) - 1 AS BIGINT) AS matrix_row, document_id, sentence_id, '' AS context, count(*) AS mention_count, count(DISTINCT canonical_id) AS unique_node_count FROM m GROUP BY document_id, sentence_id"))
def cooc_sentences(spark, d):
    return C.sentences(_m(spark, d))


_ROWS = "s AS (SELECT document_id, sentence_id, CAST(row_number() OVER (ORDER BY document_id, sentence_id) - 1 AS BIGINT) AS matrix_row FROM m GROUP BY 1, 2),\n"


@query(_x(_ALL + _ROWS, "SELECT matrix_row, matrix_index, 1 AS value FROM u JOIN s USING (document_id, sentence_id)"))
def cooc_incidence(spark, d):
    return C.incidence(_m(spark, d))


@query(_x(_ALL, "SELECT * FROM e"))
def cooc_edges(spark, d):
    return C.edges(_m(spark, d))


@query(_x(_ALL + _ROWS, """, p AS (SELECT document_id, sentence_id, canonical_id, count(*) AS k, array_to_string(list_sort(list(DISTINCT text)), ' | ') AS texts, array_to_string(list_sort(list(DISTINCT ambiguity)), ' | ') AS ambiguities FROM m GROUP BY ALL),
q AS (SELECT p.*, matrix_index, matrix_row FROM p JOIN n USING (canonical_id) JOIN s USING (document_id, sentence_id))
SELECT a.matrix_index AS source_index, b.matrix_index AS target_index, a.matrix_row AS sentence_row, a.document_id, a.sentence_id, a.k AS source_mention_count, b.k AS target_mention_count, a.texts AS source_texts, b.texts AS target_texts, a.ambiguities AS source_ambiguities, b.ambiguities AS target_ambiguities
FROM q a JOIN q b ON a.document_id = b.document_id AND a.sentence_id = b.sentence_id AND a.matrix_index < b.matrix_index"""))
def cooc_observations(spark, d):
    return C.observations(_m(spark, d))


@query(_x(_ALL, "SELECT source_index AS \"row\", target_index AS \"column\", sentence_count AS value FROM e UNION ALL SELECT target_index, source_index, sentence_count FROM e"))
def cooc_adjacency(spark, d):
    return C.adjacency(C.edges(_m(spark, d)))


@query(_x(_ALL + _TABLE, "SELECT source_index, target_index, source_canonical_id, target_canonical_id, source_name, target_name, source_category, target_category, source_layer, target_layer, category_pair, layer_pair, sentence_count, document_count FROM t"))
def cooc_edge_table(spark, d):
    return C.edge_table(*_network(spark, d))


@query(_x(_ALL + _GROUPS, "SELECT * FROM cells"))
def cooc_blocks(spark, d):
    return C.block_entries(*_network(spark, d))


@query(_x(_ALL + _GROUPS, """SELECT b.matrix, b.matrix || '.mtx' AS filename, b.row_group, b.column_group, (SELECT count(*) FROM gm WHERE grp = b.row_group) AS rows, (SELECT count(*) FROM gm WHERE grp = b.column_group) AS columns,
 count(c.value) AS nonzero_cells, CAST(count(c.value) / CASE WHEN b.row_group = b.column_group THEN 2 ELSE 1 END AS BIGINT) AS undirected_edge_count,
 CAST(coalesce(sum(c.value), 0) / CASE WHEN b.row_group = b.column_group THEN 2 ELSE 1 END AS BIGINT) AS total_sentence_cooccurrences FROM b LEFT JOIN cells c USING (matrix) GROUP BY b.matrix, b.row_group, b.column_group"""))
def cooc_block_manifest(spark, d):
    return C.block_manifest(*_network(spark, d))


@query(_x(_ALL + _TABLE, """, r(c, k) AS (VALUES ('CHAR', 0), ('PRAC', 1), ('INFRA', 2), ('GOV', 3), ('LOC', 4)), z AS (SELECT category AS c, count(*) AS k FROM n GROUP BY 1),
p AS (SELECT a.c AS source_category, b.c AS target_category, coalesce(x.k, 0) AS source_nodes, coalesce(y.k, 0) AS target_nodes FROM r a JOIN r b ON a.k <= b.k LEFT JOIN z x ON x.c = a.c LEFT JOIN z y ON y.c = b.c),
w AS (SELECT category_pair, count(*) AS k, CAST(sum(sentence_count) AS BIGINT) AS s, max(sentence_count) AS mx FROM t GROUP BY 1),
f AS (SELECT p.*, CAST(CASE WHEN source_category = target_category THEN source_nodes * (source_nodes - 1) // 2 ELSE source_nodes * target_nodes END AS BIGINT) AS possible_pairs, coalesce(k, 0) AS observed_edges, coalesce(s, 0) AS total, coalesce(mx, 0) AS mx FROM p LEFT JOIN w ON category_pair = source_category || '--' || target_category)
SELECT source_category, target_category, source_nodes, target_nodes, possible_pairs, observed_edges, CASE WHEN possible_pairs > 0 THEN round_even(observed_edges / possible_pairs, 8) ELSE 0.0 END AS density, total AS total_sentence_cooccurrences, CASE WHEN observed_edges > 0 THEN round_even(total / observed_edges, 6) ELSE 0.0 END AS mean_weight_observed_edges, mx AS max_weight FROM f"""))
def cooc_category_pairs(spark, d):
    return C.category_pairs(*_network(spark, d))


@query(_x(_ALL, """SELECT (SELECT count(*) FROM m) AS database_mentions, (SELECT count(*) FROM n) AS canonical_nodes, """ + ", ".join(f"(SELECT count(*) FROM n WHERE category = '{c}') AS \"nodes_{c}\"" for c in S.CATEGORIES) + ", " + ", ".join(f"(SELECT CAST(sum(ambiguity_{a}) AS BIGINT) FROM n) AS mentions_{a}" for a in ("low", "medium", "high", "other")) + """,
 (SELECT count(*) FROM (SELECT DISTINCT document_id, sentence_id FROM m)) AS sentences, (SELECT count(*) FROM u) AS sentence_node_presences, (SELECT CAST(sum(sentence_count) AS BIGINT) FROM e) AS edge_observations,
 (SELECT count(*) FROM e) AS undirected_edges, (SELECT CAST(sum(sentence_count) AS BIGINT) FROM e) AS total_sentence_cooccurrences, (SELECT max(sentence_count) FROM e) AS max_edge_weight"""))
def cooc_summary(spark, d):
    return C.summary(_m(spark, d))


@query(_x("WITH " + _M, """, a AS (SELECT category, text, start, sentence_id, ambiguity FROM m), b AS (SELECT category, text, start, sentence_id, CASE WHEN start = 100 THEN NULL ELSE ambiguity END AS ambiguity FROM m)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right,
 (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AS equal"""))
def mentions_multiset_diff(spark, d):
    a = _m(spark, d).select("category", "text", "start", "sentence_id", "ambiguity")
    return C.multiset_difference(a, a.withColumn("ambiguity", F.when(F.col("start") != 100, F.col("ambiguity"))))


def _dense(spark, d, texts=False):
    """What its units are made from, nodes and edges of a network of few nodes."""
    m = V.mentions(spark, d, "l_suppkey")
    once = C.units(m, texts)
    nodes = checkpointed(C.nodes(m, once))
    return (m, once), nodes, C.edge_table(C.edges(m, once), nodes)


_DALL = "WITH RECURSIVE " + _DENSE + _NODES + _EDGES + _TABLE + f"k AS (SELECT * FROM t WHERE sentence_count >= {_HEAVY}),\nds AS (SELECT canonical_id, count(*) AS degree, CAST(sum(w) AS BIGINT) AS strength FROM (SELECT source_canonical_id AS canonical_id, sentence_count AS w FROM k UNION ALL SELECT target_canonical_id, sentence_count FROM k) GROUP BY 1),\n"
_COMP = """both_ways AS (SELECT source_canonical_id AS a, target_canonical_id AS b FROM k UNION ALL SELECT target_canonical_id, source_canonical_id FROM k),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
root AS (SELECT a AS canonical_id, min(b) AS root FROM reach GROUP BY a),
sized AS (SELECT root, count(*) AS component_size, list_sort(list(lower(canonical_name))) AS names FROM root JOIN n USING (canonical_id) GROUP BY root),
ranked AS (SELECT root, component_size, CAST(row_number() OVER (ORDER BY component_size DESC, names, root) AS INTEGER) AS component FROM sized),
cn AS (SELECT n.*, CAST(row_number() OVER (PARTITION BY n.layer ORDER BY n.matrix_index) - 1 AS BIGINT) AS layer_index, ds.degree, ds.strength, component, component_size FROM n JOIN ds USING (canonical_id) JOIN root USING (canonical_id) JOIN ranked USING (root)),
"""


@query(_x(_DALL, "SELECT source_canonical_id, target_canonical_id, category_pair, layer_pair, sentence_count, document_count FROM k"))
def core_edges(spark, d):
    return N.core_edges(_dense(spark, d)[2], _HEAVY).select(*N.ENDS, "category_pair", "layer_pair", "sentence_count", "document_count")


@query(_x(_DALL, "SELECT * FROM ds"))
def core_degree_strength(spark, d):
    return N.degrees(N.core_edges(_dense(spark, d)[2], _HEAVY))


def _core(spark, d, isolates=False):
    _, nodes, table = _dense(spark, d)
    core = checkpointed(N.core_edges(table, _HEAVY))
    return core, N.core_nodes(core, nodes, isolates)


@query(_x(_DALL + _COMP, "SELECT canonical_id, component, component_size FROM cn"))
def core_components(spark, d):
    return _core(spark, d)[1].select("canonical_id", "component", "component_size")


@query(_x(_DALL + _COMP, "SELECT canonical_id, canonical_name, category, layer, matrix_index, mention_count, sentence_count, degree, strength, component, component_size, ambiguity_low, ambiguity_medium, ambiguity_high FROM cn"))
def core_nodes(spark, d):
    return N.ordered_nodes(_core(spark, d)[1]).select("canonical_id", "canonical_name", "category", "layer", "matrix_index", "mention_count", "sentence_count", "degree", "strength", "component", "component_size", "ambiguity_low", "ambiguity_medium", "ambiguity_high")


@query(_x(_DALL, "SELECT n.canonical_id, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength FROM n LEFT JOIN ds USING (canonical_id)"))
def core_isolates(spark, d):
    return _core(spark, d, True)[1].select("canonical_id", "degree", "strength")


@query(_x(_DALL, "SELECT n.canonical_id, canonical_name, category, degree, strength FROM n JOIN ds USING (canonical_id) ORDER BY strength DESC, degree DESC, canonical_name, canonical_id LIMIT 10"))
def core_top10(spark, d):
    return N.top_by_strength(_core(spark, d)[1]).select("canonical_id", "canonical_name", "category", "degree", "strength")


@query(_x(_DALL, "SELECT category_pair, count(*) AS edges FROM k GROUP BY 1"))
def core_pair_counts(spark, d):
    return N.pair_counts(N.core_edges(_dense(spark, d)[2], _HEAVY))


@query(_x(_DALL, ", c(category) AS (VALUES ('CHAR'), ('PRAC'), ('INFRA'), ('GOV'), ('LOC')) SELECT c.category, count(ds.canonical_id) AS nodes FROM c LEFT JOIN n ON n.category = c.category LEFT JOIN ds ON ds.canonical_id = n.canonical_id GROUP BY 1"))
def core_category_counts(spark, d):
    return N.category_counts(_core(spark, d)[1])


def _observed(m, nodes):
    side = lambda p: nodes.select(F.col("matrix_index").alias(f"{p}_index"), F.col("canonical_id").alias(f"{p}_canonical_id"))
    return C.observations(*m).join(side("source"), "source_index").join(side("target"), "target_index")


_EV = """p AS (SELECT document_id, sentence_id, canonical_id, array_to_string(list_sort(list(DISTINCT text)), ' | ') AS texts, array_to_string(list_sort(list(DISTINCT ambiguity)), ' | ') AS ambiguities FROM m GROUP BY ALL),
q AS (SELECT p.*, matrix_index FROM p JOIN n USING (canonical_id)),
ev AS (SELECT least(x.canonical_id, y.canonical_id) AS a, greatest(x.canonical_id, y.canonical_id) AS b, x.document_id, x.sentence_id, '' AS context, x.texts AS source_texts, y.texts AS target_texts, x.ambiguities AS source_ambiguities, y.ambiguities AS target_ambiguities
 FROM q x JOIN q y ON x.document_id = y.document_id AND x.sentence_id = y.sentence_id AND x.matrix_index < y.matrix_index JOIN k ON k.source_index = x.matrix_index AND k.target_index = y.matrix_index),
"""


@query(_x(_DALL + _EV, "SELECT * FROM ev"))
def core_evidence(spark, d):
    m, nodes, table = _dense(spark, d, texts=True)
    return N.evidence(N.core_edges(table, _HEAVY), _observed(m, nodes), C.sentences(m[0]))


@query(_x(_DALL + _EV, "SELECT k.source_canonical_id, k.target_canonical_id, source_name, target_name, source_category, target_category, category_pair, layer_pair, sentence_count, (SELECT count(*) FROM ev WHERE ev.a = least(k.source_canonical_id, k.target_canonical_id) AND ev.b = greatest(k.source_canonical_id, k.target_canonical_id)) AS evidence_count FROM k"))
def core_edge_export(spark, d):
    m, nodes, table = _dense(spark, d, texts=True)
    core = N.core_edges(table, _HEAVY)
    return N.edge_export(core, N.evidence(core, _observed(m, nodes), C.sentences(m[0])))


@query(_x(_DALL, "SELECT n.canonical_id, round_even(8.0 + 9.0 * sqrt(strength / (SELECT max(strength) FROM ds)), 2) AS radius, 520.0 + 1180.0 * sqrt(strength / (SELECT max(strength) FROM ds)) AS size FROM n JOIN ds USING (canonical_id)"))
def core_visual_nodes(spark, d):
    return N.visual_nodes(_core(spark, d)[1]).select("canonical_id", "radius", "size")


@query(_x(_DALL, f"SELECT source_canonical_id, target_canonical_id, 1.0 + 0.85 * sqrt(greatest(sentence_count - {_HEAVY} + 1, 1)) AS width FROM k"))
def core_edge_widths(spark, d):
    return N.core_edges(_dense(spark, d)[2], _HEAVY).select(*N.ENDS, N.edge_width("sentence_count", _HEAVY).alias("width"))


@query(_x(_DALL, f""", w AS (SELECT canonical_id, count(*) AS degree_g1, CAST(sum(v) AS BIGINT) AS strength_g1, count(*) FILTER (v >= {_HEAVY}) AS degree_g3, CAST(coalesce(sum(v) FILTER (v >= {_HEAVY}), 0) AS BIGINT) AS strength_g3
 FROM (SELECT source_canonical_id AS canonical_id, sentence_count AS v FROM t UNION ALL SELECT target_canonical_id, sentence_count FROM t) GROUP BY 1)
SELECT canonical_id, canonical_name, category, mention_count, sentence_count, coalesce(degree_g1, 0) AS degree_g1, coalesce(strength_g1, 0) AS strength_g1, coalesce(degree_g3, 0) AS degree_g3, coalesce(strength_g3, 0) AS strength_g3 FROM n LEFT JOIN w USING (canonical_id)"""))
def audit_node_metrics(spark, d):
    _, nodes, table = _dense(spark, d)
    return A.node_metrics(nodes, table, _HEAVY)


@query(_x(_DALL, "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM t) AS edges, (SELECT CAST(sum(sentence_count) AS BIGINT) FROM t) AS total_edge_weight, (SELECT max(sentence_count) FROM t) AS max_edge_weight, (SELECT count(*) FROM k) AS g3_edges, (SELECT CAST(sum(sentence_count) AS BIGINT) FROM k) AS g3_total_edge_weight, (SELECT count(*) FROM ds) AS g3_nodes"))
def audit_network_summary(spark, d):
    _, nodes, table = _dense(spark, d)
    s = A.network_summary(nodes, table, _HEAVY)
    # A run's own summary says 0 for the weight of no edges, SQL null.
    none = {"total_edge_weight": "edges", "max_edge_weight": "edges", "g3_total_edge_weight": "g3_edges"}
    return s.withColumns({c: F.when(F.col(n) > 0, F.col(c)) for c, n in none.items()})


@query(_x(_DALL, "SELECT source_canonical_id, source_name, source_category, target_canonical_id, target_name, target_category, sentence_count FROM k"))
def audit_heavy_edges(spark, d):
    return A.heavy_edges(_dense(spark, d)[2], _HEAVY)


@query(_x("WITH " + _M, """, x AS (SELECT document_id, sentence_id, canonical_id, canonical_name, CASE WHEN start = 300 THEN 'NONE' ELSE category END AS category, start, CASE WHEN start = 200 THEN start ELSE start + length(text) END AS fin FROM m)
SELECT 'category' AS rule, document_id || '/' || sentence_id || '/' || canonical_id AS key, 'category not allowed' AS message FROM x WHERE category = 'NONE'
UNION ALL SELECT 'offsets', document_id || '/' || sentence_id || '/' || canonical_id, 'invalid offsets' FROM x WHERE fin <= start
UNION ALL SELECT 'identity', canonical_id, 'one canonical_id with several names or categories' FROM (SELECT canonical_id FROM (SELECT DISTINCT canonical_id, canonical_name, category FROM x) GROUP BY 1 HAVING count(*) > 1)"""))
def rule_violations(spark, d):
    """Mentions with faults planted: every third of a sentence has a bad category, every second an empty span."""
    m = _m(spark, d).withColumn("category", F.when(F.col("start") == 300, "NONE").otherwise(F.col("category"))).withColumn("end", F.when(F.col("start") == 200, F.col("start")).otherwise(F.col("end")))
    return R.mention_rules(m)
