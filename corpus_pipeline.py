"""A corpus pipeline: low quality, exact copies and near copies go, secrets are masked, and what stays is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of ``docs``. Near copies are judged on five-word shingles. Texts reach Python in batches of
few rows, as a task holds a batch several times over: in the JVM, on the way, as objects, and as what is made of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from txnlens.llm import exact_stream, guess_cost, harmonic_pack, quality_trees, simhash_blocks
from txnlens.llm.common import kept_table, read_documents


#: Documents of a batch that goes to Python, at most.
BATCH_ROWS = 256
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with short batches from its start on: what it returns is planned only when it is written."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)
    return run


@short_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_trees.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@short_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_stream.without_copies(docs)


@short_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_blocks.drop_near(docs, seeds=simhash_blocks.SEEDS)


@short_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return guess_cost.masked(docs, public_tokenizers.path("word_bpe_49k.json"))


@short_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return harmonic_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

# Fitted trees and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_documents(spark, sf_dir), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            docs, _ = kept_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
