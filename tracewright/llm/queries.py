"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, licences, lines, media, mixing, pii, quality, secrets, tokens
from ._frames import read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read_table(spark, sf_dir, "documents"))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op3_bpe_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.forest_join(read_table(spark, sf_dir, "documents"))


def op6_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(read_table(spark, sf_dir, "documents"))


def op8_licence_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.document_path(read_table(spark, sf_dir, "documents")))


def op9_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_bpe_heap": op3_bpe_heap,
    "op4_zstd_novelty": op4_zstd_novelty,
    "op5_minhash_forest": op5_minhash_forest,
    "op6_multinomial_mix": op6_multinomial_mix,
    "op7_segment_join": op7_segment_join,
    "op8_licence_tfidf": op8_licence_tfidf,
    "op9_pigeonhole_leaks": op9_pigeonhole_leaks,
    "op10_kneser_ney": op10_kneser_ney,
}

ORACLE_SQL: dict[str, str] = {
    "op6_multinomial_mix": mixing.mix_sql(),
    "op8_licence_tfidf": licences.scan_sql(),
}
