"""Incremental runs: documents are picked up as they arrive, each micro-batch resolved against the registry as it then is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra import schemas as S
from papyra.operators import resolution as R
from papyra.plans.durable import checkpointed
from papyra.sources import sinks


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def arriving_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files as they arrive in a folder."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def arriving_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of annotation files as they arrive in a folder; a file without any is one row with no mention_index."""
    files = spark.readStream.schema(S.NER_FILE).option("multiLine", "true").json(path)
    return files.select("document_id", F.posexplode_outer("entities").alias("mention_index", "e")).select("document_id", "mention_index", "e.*")


def resolve_batch(batch: DataFrame, folder: str) -> None:
    """Resolves a batch and stores mentions (in place of the same documents'), new canonicals and new aliases.

    A document whose rows have no mention_index has no mentions any more.

    Writes are by key, so a batch that is run again after a failure stores the same.
    """
    spark, mentions = batch.sparkSession, batch.where("mention_index is not null")
    registry, aliases = _stored(spark, f"{folder}/canonicals", S.CANONICAL), _stored(spark, f"{folder}/aliases", S.ALIAS)
    resolved = checkpointed(R.resolve(mentions, checkpointed(registry), checkpointed(aliases)))
    made = R.registered(resolved, registry.limit(0))
    sinks.append_new(made, f"{folder}/canonicals", ["id"])
    sinks.append_new(R.new_aliases(resolved, aliases), f"{folder}/aliases", ["canonical_id", "normalized_alias"])
    sinks.replace_mentions(spark, resolved.drop("normalized"), f"{folder}/mentions", batch.select("document_id"))


def resolve_stream(mentions: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A stream of mentions resolved batch by batch; with available_now it ends when what is there is done."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            resolve_batch(batch, folder)

    writer = mentions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def edge_counts(mentions: DataFrame, time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Streaming mention counts of canonicals by window of event time; rows later than the delay don't count."""
    return mentions.withWatermark(time, delay).groupBy(F.window(time, window), "canonical_id").agg(F.count(F.lit(1)).alias("mentions"), F.approx_count_distinct("sentence_id").alias("sentences"))
