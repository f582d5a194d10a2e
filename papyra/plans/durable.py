"""Session matters: lineage cut with files that all executors share, one pool of Python workers, and small batches for them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once, but for the last row; Spark's own 64 MB are held several times over, for each running task.
BATCH_BYTES = 4 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; a folder of our own only where there is none and all run on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="papyra-checkpoints-"))


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def one_worker_pool(spark: SparkSession) -> None:
    """Lets all kinds of Python steps use the same workers.

    Workers are pooled by their environment, and short tracebacks, which only some
    kinds of steps have, are part of it: with them an executor keeps twice as many
    idle workers.
    """
    spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python step has of its rows at once, in the JVM's buffers and in the worker; groups still arrive whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
