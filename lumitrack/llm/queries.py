"""The registered queries of this subpackage, one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumitrack.llm import chat_format, decontamination, fingerprints, language_id, mixing, ngram_join, periodic_runs, pii, secrets, sharding, token_counts, url_reputation, whitening
from lumitrack.llm.common import table
from lumitrack.llm.oracles import ORACLES

VOCABULARY = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op1(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op3(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op5(table(spark, sf_dir, "documents"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.op6(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op8(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op10(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op11(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op12(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_token_counts, op2_slot_sharding, op3_language_id, op4_decontamination, op5_secret_scan, op6_url_reputation, op7_source_mix, op8_fingerprints,
    op9_pii, op10_ngram_join, op11_chat_format, op12_periodic_runs, op13_whitening,
)
QUERIES = {f.__name__: f for f in (*OPERATORS, pipeline)}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
