"""Queries over the driver's tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import arrow_sequences, host_paths, line_dedup, ogg, packing, pu_quality, quality_ledger, sentencepiece_codec, simhash, suffix_dedup
from ._shared import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.main_text(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op4_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_sequences.sequence_store(table(spark, sf_dir, "documents"), WORD_FILE, end_id=2)


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.to_media(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.verdicts(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), WORD_FILE, end_id=0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_sentencepiece, op3_line_dedup, op4_arrow_sequences, op5_ogg, op6_suffix_dedup, op7_quality_rules, op8_packing, op9_simhash, op10_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op7_quality_rules": quality_ledger.SQL}
