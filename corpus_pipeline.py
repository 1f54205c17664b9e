"""A training-data pipeline: five operators of lumitrack.llm in a row, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet and rereads it as the
next one's ``docs``. All but the last return the columns of ``docs``; the last adds the shard. SQL can't express the
stages, so ORACLE_SQL is None, and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumitrack.llm import decontamination, language_id, mixing, ngram_join, sharding
from lumitrack.llm.common import stored, table

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach stay."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, ngram_join.Measure(5, 80))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources have their target weights."""
    return mixing.mixed(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and virtual slot."""
    placed, _ = sharding.sharded(docs, SHARDS)
    return placed.select(*(c for c in placed.columns if c not in ("shard", "virtual_slot")), "shard", "virtual_slot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shards", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
