"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from archipelago.llm.conversation_trie import grafted, numbered_turns, prefix_trie
from archipelago.llm.cotrain import quality_scores
from archipelago.llm.decontaminate import contamination
from archipelago.llm.line_dedup import line_dedup
from archipelago.llm.minhash_dedup import near_duplicates
from archipelago.llm.mixing import mix_report, tempered_targets
from archipelago.llm.oracle import oracle_sql  # noqa: F401
from archipelago.llm.quality_rules import quality_rules
from archipelago.llm.spelling import counted_words, spelling_variants
from archipelago.llm.substring import repeated_passages
from archipelago.llm.token_count import token_counts
from archipelago.llm.token_shards import token_sequences
from archipelago.llm.toxicity import toxicity
from archipelago.llm.url_filter import Rule, filter_urls

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80).drop("links")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"), tempered_targets(power=0.8), budget_share=0.6)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*grafted(numbered_turns(_table(spark, sf_dir, "conversations"))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(_table(spark, sf_dir, "documents"), every=31))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_token_shards, op3_minhash_dedup, op4_url_filter, op5_quality_classifier, op6_token_counts, op7_quality_rules, op8_substring_dedup, op9_decontamination, op10_mixing, op11_conversation_trie, op12_toxicity, op13_spelling_variants)}
