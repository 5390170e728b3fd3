"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automaton_dedup, block_dedup, bpe, class_lm, mixing, near_dups, quality, secrets, suffix_dedup, token_store
from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_components(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.exact_groups(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(documents(spark, sf_dir))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = token_store.write_store(documents(spark, sf_dir), definition, public_tokenizers.PATTERN, end_id=2, added=True)
    return token_store.read_checksums(token_store.open_store(spark, path))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.dedup_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_ngram_jaccard, op3_exact_dedup, op4_byte_bpe, op5_class_lm, op6_token_store, op7_quality_rules, op8_secret_scan, op9_substring_dedup, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op2_ngram_jaccard": near_dups.ORACLE, "op3_exact_dedup": block_dedup.ORACLE, "op7_quality_rules": quality.ORACLE, "op9_substring_dedup": automaton_dedup.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE}
