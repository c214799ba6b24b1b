"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import common, decontamination, exact_dedup, jaccard_join, language_id, license_scan, media_audio, mixing, packing, pii, sharding, token_store, vector_codes, whitening

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file is; a folder overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "tokens")
    token_store.write_store(_documents(spark, sf_dir), path, vocabulary_path(WORD_VOCABULARY))
    return token_store.read_store(spark, path)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_documents(spark, sf_dir))


def op4_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary_path(BYTE_VOCABULARY))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.media_features(media_audio.stored_media(_documents(spark, sf_dir))).drop("frame_offsets")


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir))


def op11_segment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_store": op2_token_store,
    "op3_pii": op3_pii,
    "op4_water_filling": op4_water_filling,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_stratified_shards": op9_stratified_shards,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_segment_codes": op11_segment_codes,
    "op12_svd_whitening": op12_svd_whitening,
    "op13_winnowing": op13_winnowing,
}

ORACLES: dict[str, str] = {
    "op4_water_filling": mixing.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_segment_codes": vector_codes.ORACLE_SQL,
    "op13_winnowing": decontamination.ORACLE_SQL,
}
