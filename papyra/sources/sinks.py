"""Where results go: CSV, MatrixMarket, GraphML, JSON, HTML, and tables changed in part.

Files that people open are single files in order; they hold a network's core or a
run's summary. Everything that grows with a corpus is written by Spark in parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import network as N
from papyra.plans.durable import checkpointed

#: Folders that stored mentions are dealt over.
MENTION_BUCKETS = 512


def _put(spark: SparkSession, path: str, pieces: Iterator[str]) -> None:
    """Writes one text file through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for s in pieces:
            out.write(bytearray(s.encode("utf-8")))
    finally:
        out.close()


def delete(spark: SparkSession, path: str | None) -> bool:
    """Deletes a file or folder if it is there."""
    if not path:
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def csv(df: DataFrame, path: str, header_if_empty: bool = True) -> None:
    """CSV parts with a header; an empty result is a header alone, or an empty file."""
    if df.isEmpty():
        _put(df.sparkSession, f"{path}/part-00000.csv", iter([",".join(df.columns) + "\n" if header_if_empty else ""]))
    else:
        df.write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "false").csv(path)


def _cell(v) -> str:
    s = "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s


def csv_file(df: DataFrame, path: str, header_if_empty: bool = True) -> None:
    """One CSV file in the frame's order, streamed partition by partition."""

    def rows() -> Iterator[str]:
        first = True
        for r in df.toLocalIterator():
            if first:
                yield ",".join(df.columns) + "\r\n"
            first = False
            yield ",".join(map(_cell, r)) + "\r\n"
        if first and header_if_empty:
            yield ",".join(df.columns) + "\r\n"

    _put(df.sparkSession, path, rows())


def matrix_market(entries: DataFrame, path: str, rows: int, columns: int, description: str, row: str = "row", column: str = "column", value: str = "value") -> None:
    """An integer general coordinate matrix, entries sorted and counted from one."""
    n = entries.count()
    lines = entries.orderBy(row, column).select(F.format_string("%d %d %d\n", F.col(row) + 1, F.col(column) + 1, F.col(value)).alias("l"))

    def pieces() -> Iterator[str]:
        yield f"%%MatrixMarket matrix coordinate integer general\n% {description}\n% Los índices de este formato son base uno.\n{rows} {columns} {n}\n"
        for r in lines.toLocalIterator():
            yield r["l"]

    _put(entries.sparkSession, path, pieces())


def json_file(spark: SparkSession, value: dict, path: str) -> None:
    _put(spark, path, iter([json.dumps(value, ensure_ascii=False, indent=2), "\n"]))


_KIND = {int: "long", float: "double", bool: "boolean", str: "string"}


def graphml(core_nodes: DataFrame, core_edges: DataFrame, path: str, **about) -> None:
    """An undirected GraphML file of a core, with all columns as attributes."""
    nodes, edges = [r.asDict() for r in core_nodes.toLocalIterator()], [r.asDict() for r in core_edges.toLocalIterator()]
    keys: dict[tuple[str, str], str] = {}

    def data(kind: str, values: dict) -> str:
        out = ""
        for k, v in values.items():
            if v is not None:
                id_ = keys.setdefault((kind, k, _KIND.get(type(v), "string")), f"d{len(keys)}")
                out += f'<data key="{id_}">{escape(str(v).lower() if isinstance(v, bool) else str(v))}</data>'
        return out

    body = [data("graph", about)]
    body += [f"<node id={quoteattr(r['canonical_id'])}>{data('node', r)}</node>\n" for r in nodes]
    ends = N.ENDS
    body += [f"<edge source={quoteattr(r[ends[0]])} target={quoteattr(r[ends[1]])}>{data('edge', {'weight': r['sentence_count'], **{k: r[k] for k in ('document_count', 'category_pair', 'layer_pair') if k in r}})}</edge>\n" for r in edges]
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    head += "".join(f'<key id="{i}" for="{kind}" attr.name={quoteattr(name)} attr.type="{t}"/>\n' for (kind, name, t), i in keys.items())
    _put(core_nodes.sparkSession, path, iter([head, '<graph edgedefault="undirected">\n', *body, "</graph>\n</graphml>\n"]))


_PAGE = """<!doctype html><html lang="es"><head><meta charset="utf-8"><title>Network</title><style>
body{font-family:sans-serif;margin:1em}svg{border:1px solid #ccc;width:100%;height:640px}line{stroke:#999}text{font-size:10px}
</style></head><body><h1 id="title"></h1>
<label>Least weight <input id="weight" type="number" min="1"></label> <label>Category <select id="category"><option value="">all</option></select></label>
<label>Name <input id="name"></label> <label><input id="free" type="checkbox"> free layout</label>
<svg viewBox="0 0 1200 780"></svg><ol id="evidence"></ol>
<script>const data = @DATA@;
const by = id => document.getElementById(id), svg = document.querySelector("svg"), ns = "http://www.w3.org/2000/svg";
by("title").textContent = data.networkTitle; by("weight").value = data.minimumWeight;
data.categoryOrder.forEach(c => by("category").add(new Option(c, c)));
const put = (tag, attributes, text) => { const e = document.createElementNS(ns, tag); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; svg.append(e); return e; };
const show = e => { by("evidence").replaceChildren(...e.evidence.map(x => Object.assign(document.createElement("li"), {textContent: x.sentence_id + ": " + x.context + " [" + x.source_texts + " / " + x.target_texts + "]"}))); };
function draw() {
  svg.replaceChildren(); const least = +by("weight").value || 1, c = by("category").value, q = by("name").value.toLowerCase(), layout = by("free").checked ? "free" : "layered";
  const nodes = new Map(data.nodes.filter(n => (!c || n.category === c) && (!q || n.name.toLowerCase().includes(q))).map(n => [n.id, n]));
  for (const e of data.edges) { const a = nodes.get(e.source), b = nodes.get(e.target); if (a && b && e.weight >= least) put("line", {x1: a[layout].x, y1: a[layout].y, x2: b[layout].x, y2: b[layout].y, "stroke-width": Math.sqrt(e.weight)}).onclick = () => show(e); }
  for (const n of nodes.values()) { put("circle", {cx: n[layout].x, cy: n[layout].y, r: n.radius, fill: data.styles[n.category].color}); put("text", {x: n[layout].x + n.radius, y: n[layout].y}, n.name); }
}
document.querySelectorAll("input,select").forEach(e => e.oninput = draw); draw();
</script></body></html>
"""


def html(spark: SparkSession, payload: dict, path: str) -> None:
    """A page of its own that shows the payload; filters by weight, category and name."""
    data = json.dumps(payload, ensure_ascii=False, default=str).replace("</", "<\\/")
    _put(spark, path, iter([_PAGE.replace("@DATA@", data)]))


def replace_partitions(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Replaces the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_mentions(spark: SparkSession, mentions: DataFrame, path: str, documents: DataFrame | None = None, buckets: int = MENTION_BUCKETS) -> None:
    """Stores the mentions of documents in place of what was stored of them, all with one time; the second score isn't stored.

    documents (document_id) are those that were processed, also those that now have
    no mention; without it they are the documents of the mentions. The table is dealt
    over buckets of documents, and only the buckets of these documents are rewritten.
    """
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int").alias("bucket")
    done = checkpointed((documents if documents is not None else mentions).select("document_id", bucket).distinct())
    touched = {r["bucket"] for r in done.select("bucket").distinct().collect()}
    rows = mentions.drop("second_match_score").withColumn("created_at", F.current_timestamp()).withColumn("bucket", bucket)
    try:
        stored = spark.read.parquet(path).where(F.col("bucket").isin(*touched))
        rows = rows.unionByName(stored.join(done.select("document_id"), "document_id", "left_anti"), allowMissingColumns=True)
    except Exception as e:  # the first write makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = checkpointed(rows)
    replace_partitions(rows.repartition("bucket"), path, "bucket")
    for b in touched - {r["bucket"] for r in rows.select("bucket").distinct().collect()}:
        delete(spark, f"{path}/bucket={b}")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose keys aren't stored; of equal ones in df one is kept."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path).select(*keys)
    except Exception as e:  # the first append makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], df.select(*keys).schema)
    df.dropDuplicates(keys).join(stored, keys, "left_anti").write.mode("append").parquet(path)
