"""Registered queries of the text operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkdemand.llm import alignment, centroids, fingerprints, language, near_dedup, packing, quality, sentence_pieces, sharding, substring_dedup, suffix_dedup, token_counts, url_filter
from sparkdemand.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(table(spark, sf_dir, "documents"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_digest(table(spark, sf_dir, "documents"), *paths)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_words_digest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_url_filter,
        op3_power_of_two_packing,
        op4_byte_shards,
        op5_language_id,
        op6_sentencepiece,
        op7_fingerprints,
        op8_quality_cascade,
        op9_token_counts,
        op10_suffix_dedup,
        op11_cross_tokenizer_alignment,
        op12_substring_dedup,
        op13_centroid_clustering,
    )
}
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_dedup.NEAR_SQL,
    "op2_url_filter": url_filter.FILTER_SQL,
    "op8_quality_cascade": quality.QUALITY_SQL,
    "op12_substring_dedup": substring_dedup.REPEAT_WORDS_SQL,
    "op13_centroid_clustering": centroids.CLUSTER_SQL,
}
