"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plainsql.llm import bpe, compact_windows, dart_minhash, language_id, packing, quality_ftrl, quality_rules, suffix_dedup, telephony, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.deduplicated(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(telephony.as_media(table(spark, sf_dir, "documents")))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_compact_windows, op2_language_id, op3_telephony, op4_suffix_array, op5_quality_rules, op6_bpe, op7_packing, op8_quality_classifier, op9_dart_minhash, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.sql()}
