"""Corpus pipeline: language, near copies, benchmark passages, mixing, shards.

``STAGES`` lists the stages in order. A stage takes ``(spark, docs, sf_dir)`` and
returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and
reads it back as the next stage's documents, so that a lost executor costs no earlier
stage. One pipeline runs at a time in a session. All stages but the last return the columns of ``documents``; the last adds the
shard and the slot of every row. The mix repeats rows, so ids may repeat from there on.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from grievaline.llm import decontaminate, langid, mixing, shards, simhash
from grievaline.sources.tables import read_table
from grievaline.sources.workdir import owned, pinned, release

SCRATCH = "corpus_pipeline"

# Hypervectors, fingerprints and random offsets are not in SQL's reach.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return langid.accepted(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.first_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in uniformly shuffled shards 0 to 7, with their slots."""
    return shards.shuffle_into_shards(docs, 8)


def tidy(stage):
    """``stage`` that first deletes what the stage before it had to write on the way.

    By then that stage's result is written, and nothing reads its intermediate tables.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, SCRATCH)
        with owned(SCRATCH):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", tidy(language_id)),
    ("simhash_near_dedup", tidy(simhash_near_dedup)),
    ("benchmark_decontamination", tidy(benchmark_decontamination)),
    ("mixing_to_target_weights", tidy(mixing_to_target_weights)),
    ("sharding", tidy(sharding)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir))
    return docs
