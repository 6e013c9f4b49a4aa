"""A training corpus from raw documents in five stages.

Each stage takes all rows that its predecessor kept and returns them with all their columns. Ids may
repeat or be null: rows are told apart by id and text, and none is lost but by a stage's own
decision. A null or empty text has no language and goes in the first stage; the others keep it. No
rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bagminhash, langid, mixing, secrets, wumanber
from fathom.llm.shared import remove, shared_dir


#: Rows of a batch that goes to Python: documents may be long, and a batch lies in memory twice on either side.
BATCH_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    """Sets the session's batch length where the stages are to run; it stays set, as their rows are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that language identification accepts; lang is what they declare, source stands for the host."""
    _short_batches(spark)
    return langid.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: that of the smallest id."""
    _short_batches(spark)
    return bagminhash.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark text occurs."""
    _short_batches(spark)
    return wumanber.without_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a secret, be it of a fixed pattern or a random string."""
    _short_batches(spark)
    return secrets.without_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: a document taken n times is n rows, told apart by copy: 0 to n - 1."""
    return mixing.repeated(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and reread, and removed once the next is there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs
