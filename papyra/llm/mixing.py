"""Mixing sources to target weights by blocks of words.

The words of each source form one stream (documents in a pseudorandom order),
cut into blocks of `BLOCK` words. The mix is a row of output shards of equal
size. Each shard draws from a multinomial how many of its slots each source
fills, with probabilities in proportion to what the sources still lack of their
targets: the draws decide what is taken, and a shard makes up for the chance of
those before it, so that shares miss their targets by the chance of one shard
only. What a source is drawn beyond `MOST` passes over its blocks is drawn again
from the others. The n-th slot that a source fills, counted over the shards, is
mapped by a pseudorandom permutation of the source's block numbers, a fresh one
for each pass, so no block is taken more often than any other by more than one.
Blocks are joined to slots by number. Positions in a stream are two-level prefix
sums, so a source that holds a third of all rows isn't sorted in one task.

Sources by code point, null last, weigh 5, 2, 1 in turn and share all words; no
target exceeds 3 times its source's words, the excess goes to the others by
weight until none is above.

Defined cases: null or blank text has size 0 and is never taken; a null source is
a source; no words at all give targets 0; repeated rows are documents of their
own; other columns, whatever their names, are ignored, or kept where documents
are returned. What the driver holds is a few numbers for each source and shard;
there are about as many shards as the 0.4th power of the number of slots.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.flat import release
from papyra.llm.rows import row_hash, whole, with_field
from papyra.plans.durable import checkpointed, one_worker_pool

BLOCK = 32
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20_240_607
#: Slots that are numbered together.
PIECE = 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are joined by broadcast.
FEW_SOURCES = 10_000


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of all words by weight, none above most times its own size."""
    size, w = np.array(sizes, float), np.array(weights, float)
    full, out = np.zeros(len(size), bool), np.zeros(len(size))
    while not full.all():
        left = size.sum() - out[full].sum()
        out[~full] = left * w[~full] / w[~full].sum()
        over = ~full & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        full |= over
    return out.tolist()


def shard_slots(slots: int) -> int:
    """Slots of a shard of a mix of so many."""
    return max(1, math.ceil(slots / max(1, math.ceil(slots**0.4))))


def draw(need: np.ndarray, most: np.ndarray, shard: int, rng: np.random.Generator) -> np.ndarray:
    """Counts [shard, source]: multinomial draws by what each source still lacks of its need, none above most in all."""
    left, got, out = round(float(need.sum())), np.zeros(len(need), np.int64), []
    left = min(left, int(most.sum()))
    while left:
        want, own = min(shard, left), np.zeros(len(need), np.int64)
        left -= want
        while want:
            room = most - got - own
            lack = np.where(room > 0, np.maximum(need - got - own, 0), 0)
            lack = lack if lack.sum() > 0 else room.astype(float)
            some = np.minimum(rng.multinomial(want, lack / lack.sum()), room)
            own += some
            want -= int(some.sum())
        got += own
        out.append(own)
    return np.array(out, np.int64).reshape(-1, len(need))


def permuted(rank: np.ndarray, n: np.ndarray, source: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Block of each slot: rank // n is the pass, whose permutation of range(n) maps rank % n (a Feistel network, walked until it falls below n)."""
    x = (rank % n).astype(np.uint64)
    key = (rank // n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + source.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        k, h, m = key[todo], half[todo], mask[todo]
        a, b = x[todo] >> h, x[todo] & m
        for turn in range(4):
            f = (b + np.uint64(turn + 1)) * np.uint64(0xD6E8FEB86659FD93) + k
            f ^= f >> np.uint64(32)
            f *= np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            a, b = b, (a ^ f) & m
        x[todo] = a << h | b
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _sources(sized: DataFrame) -> list[dict]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [r["size"] or 0 for r in rows]
    target = targets(size, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    return [{"sid": i, "source": r["source"], "source_size": s, "target": float(t), "blocks": -(-s // BLOCK)} for i, (r, s, t) in enumerate(zip(rows, size, target))]


def _by_source(df: DataFrame, sources: list[dict]) -> DataFrame:
    """The rows with their source's figures."""
    frame = df.sparkSession.createDataFrame(sources or [(None,) * 5], "sid long, source string, source_size long, target double, blocks long")
    small = F.broadcast(frame) if len(sources) <= FEW_SOURCES else frame
    return df.join(small.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _slots(spark: SparkSession, sources: list[dict], seed: int) -> DataFrame:
    """The mix: shard, slot (within the shard), sid, block, turn (the pass over the source)."""
    live = [s for s in sources if s["target"] > 0]
    need = np.array([s["target"] * s["blocks"] / s["source_size"] for s in live])
    shard = shard_slots(round(float(need.sum())))
    counts = draw(need, MOST * np.array([s["blocks"] for s in live], np.int64), shard, np.random.default_rng(seed))
    first, off = np.cumsum(counts, 0) - counts, np.cumsum(counts, 1) - counts
    k, j = np.nonzero(counts)
    sid, blocks = (np.array([s[c] for s in live], np.int64)[j] for c in ("sid", "blocks"))
    drawn = {"shard": k, "sid": sid, "first": first[k, j], "off": off[k, j], "n": counts[k, j], "held": counts.sum(1)[k], "blocks": blocks}
    frame = spark.createDataFrame(pd.DataFrame(drawn).astype("int64"), ", ".join(f"{c} long" for c in drawn))
    pieces = frame.withColumn("k", F.explode(F.expr(f"sequence(0L, n - 1, {PIECE}L)")))
    # Tasks follow the slots, not the shards: each numbers about half a million.
    ranks = pieces.repartition(max(4, int(counts.sum()) // (16 * PIECE)), "shard", "sid", "k").withColumn("i", F.explode(F.expr(f"sequence(k, least(k + {PIECE}, n) - 1)")))
    # Said to be nondeterministic, as a join's null check on the block would otherwise run it a second time, in a second worker for each task.
    number = F.pandas_udf(lambda r, n, s: pd.Series(permuted(r.to_numpy(), n.to_numpy(), s.to_numpy(), seed)), "long").asNondeterministic()
    rank = F.col("first") + F.col("i")
    return ranks.select(
        "shard", number(F.col("off") + F.col("i"), "held", -1 - F.col("shard")).alias("slot"), "sid", number(rank, "blocks", "sid").alias("block"), F.expr("(first + i) div blocks").alias("turn")
    )


def _uses(spark: SparkSession, sources: list[dict], seed: int) -> DataFrame:
    """How often the mix takes each block: sid, block, uses (at most MOST)."""
    return _slots(spark, sources, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))


def _placed(docs: DataFrame) -> tuple[DataFrame, list[dict]]:
    """doc_id, h, source, sid, size of the documents, and at, their first word's place in its stream."""
    one_worker_pool(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The only reading of the texts; four small columns are all that the rest works on.
    sized = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), row_hash(docs).alias("h")))
    sources = _sources(sized)
    # As many parts as documents in a part, so that both levels of sums grow with the square root.
    parts = max(1, math.isqrt(sized.count()))
    own = _by_source(sized, sources).drop("source_size", "target", "blocks").withColumn("part", F.pmod("h", F.lit(parts)))
    n = own.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("sid", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = own.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    return inside.join(before, ["sid", "part"]).withColumn("at", F.col("before") + F.col("inside")).drop("part", "before", "inside"), sources


def _cut(placed: DataFrame) -> DataFrame:
    """One row for each document and block it shares words with: those from lo to hi."""
    first, last = F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("at"), F.col("block") * BLOCK), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return cut.withColumn("lo", lo - F.col("at")).withColumn("hi", hi - F.col("at"))


def mix_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as slots: shard, slot, source, block (of the source's stream), turn."""
    sources = _placed(docs)[1]
    if not any(s["target"] for s in sources):
        return docs.sparkSession.createDataFrame([], "shard long, slot long, source string, block long, turn long")
    names = docs.sparkSession.createDataFrame([(s["sid"], s["source"]) for s in sources], "sid long, source string")
    names = F.broadcast(names) if len(sources) <= FEW_SOURCES else names
    return _slots(docs.sparkSession, sources, seed).join(names, "sid").select("shard", "slot", "source", "block", "turn")


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken."""
    placed, sources = _placed(docs)
    keys = ["doc_id", "source", "size", "sid", "at"]
    if any(s["target"] for s in sources):
        # Both sides grow with the corpus: never a broadcast.
        used = _cut(placed).select(*keys, "block", "lo", "hi").join(_uses(docs.sparkSession, sources, seed).hint("merge"), ["sid", "block"], "left")
        taken = used.groupBy(*keys).agg(F.sum(F.coalesce("uses", F.lit(0)) * (F.col("hi") - F.col("lo"))).cast("long").alias("taken"))
        taken = taken.union(placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))
    else:
        taken = placed.select(*keys, F.lit(0).cast("long").alias("taken"))
    return _by_source(taken.drop("sid"), sources).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: each with the words that it takes, in order, one line for each pass; a pass that takes all words keeps the text as it is.

    Columns are those of docs; n_chars follows the text; documents of which
    nothing is taken go.
    """
    placed, sources = _placed(docs)
    if not any(s["target"] for s in sources):
        return docs.limit(0)
    # Both sides grow with the corpus: never a broadcast.
    keys = ["sid", "at", "doc_id", "h"]
    used = _cut(placed).select(*keys, "block", "lo", "hi").join(_uses(docs.sparkSession, sources, seed).hint("merge"), ["sid", "block"])
    array = lambda c: F.transform("pieces", lambda x: x[c])
    pieces = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("lo", "hi", "uses"))))).alias("pieces"))
    # Equal rows share h, each with pieces of its own: one is kept and meets them all. Ids are compared after the join, so that the texts stay where h has dealt them.
    pieces = pieces.groupBy("h").agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), array("lo").alias("lo"), array("hi").alias("hi"), array("uses").alias("uses"))).alias("all"))
    kept = docs.select(row_hash(docs).alias("h"), whole(docs)).repartition("h").withColumn("id", F.col("row.doc_id")).dropDuplicates(["h", "id"])
    both = kept.join(pieces, "h").select("row", F.explode("all").alias("p")).where(F.col("row.doc_id").eqNullSafe(F.col("p.id")))
    text = F.pandas_udf(_taken_text, "string")
    both = both.select(with_field(docs, "text", text("row.text", "p.lo", "p.hi", "p.uses")))
    if "n_chars" in docs.columns:
        both = both.select(with_field(docs, "n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return both.select("row.*")


_word = re.compile(WORD)


def _taken_text(text: pd.Series, lo: pd.Series, hi: pd.Series, uses: pd.Series) -> pd.Series:
    out = []
    for t, a, b, u in zip(text, lo, hi, uses):
        words, passes = _word.findall(t), []
        for n in range(int(max(u))):
            own = [w for x, y, k in zip(a, b, u) if k > n for w in words[x:y]]
            passes.append(t if len(own) == len(words) else " ".join(own))
        out.append("\n".join(passes))
    said = pd.Series(out, dtype=object)
    release()
    return said
