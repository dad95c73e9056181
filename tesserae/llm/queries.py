"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import ann, decontam, fim, hmm, langid, manifest, mixing, neardup, oracle, quality, secrets, sharding, spiece, wordpiece
from tesserae.llm.common import table

SHARDS = 24
PIECES = os.environ.get("TESSERAE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_all(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digest(table(spark, sf_dir, "documents"), spiece.Segmenter(spiece.load(PIECES)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), wordpiece.load(PIECES))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("hash")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_hmm, op3_langid, op4_secrets, op5_sentencepiece, op6_token_counts, op7_sharding, op8_neardup, op9_ann, op10_decontam, op11_fim, op12_manifest, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": oracle.secrets_sql(), "op7_sharding": oracle.sharding_sql(SHARDS), "op8_neardup": oracle.neardup_sql(), "op11_fim": oracle.fim_sql(), "op12_manifest": oracle.manifest_sql(), "op13_mixing": oracle.mixing_sql()}
