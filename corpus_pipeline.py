"""From raw documents to token digests, in five stages.

Each stage takes what the one before kept, as documents; the last gives what
encoding and decoding yield for each document of the mix.

Defined cases: a null or empty text is scored, has no copies, loses nothing, and is
left out by the mix, which takes no words of it; repeated rows are copies, one
stays; an empty table gives an empty result; a null source is a source; columns
beyond those of documents, whatever their names, are carried up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from papyra.llm.mixing import mixed_documents
from papyra.llm.nearcopies import without_copies
from papyra.llm.pieces import piece_digests
from papyra.llm.quality import good_documents
from papyra.llm.queries import piece_model
from papyra.llm.suffixes import without_repeats
from papyra.plans.durable import ensure_checkpoint_dir, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    small_batches(spark)
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies."""
    small_batches(spark)
    return without_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that also stand elsewhere."""
    small_batches(spark)
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes, as documents."""
    small_batches(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text."""
    return piece_digests(docs, piece_model())


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]
#: Training, hashing draws and tokenizing aren't SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what lies between them is kept in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
