"""The corpus pipeline: from raw documents to training sequences.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.llm.decontaminate import contamination
from archipelago.llm.minhash_dedup import near_duplicates
from archipelago.llm.mixing import sample, tempered_targets
from archipelago.llm.quality_rules import rule_verdicts
from archipelago.llm.storage import store
from archipelago.llm.token_shards import token_sequences

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go.

    Every row is judged by its own text and language, whatever its id: null
    and repeated ids, too.  A null or empty text is rejected.  Of ``labels``
    only those of the stage's documents count.
    """
    judged = rule_verdicts(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the least id.

    Rows are compared as rows: repeated rows of one id are a group like any
    other, equal ids with different texts are not, and rows with a null id
    stay behind those with one.  Rows without words are in no group and stay.
    """
    rows = store(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    found = store(near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    # a row without partners is its own group; only groups of more are decided
    many = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = found.join(many, "component_id").join(rows.select("row", "doc_id").hint("shuffle_merge"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    heads = members.groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    out = store(members.select("row").join(heads.hint("shuffle_merge"), "row", "left_anti"), "copies")
    # the rows that go grow with the corpus, so they are not broadcast
    return rows.join(out.hint("shuffle_merge"), "row", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold any passage of the benchmark go.

    A row goes with the first window it shares with an item, however long its
    text is.  Texts are judged by their hash of 64 bits, so equal texts share
    their verdict and ids, null or repeated, play no part.  Null and empty
    texts hold nothing and stay.
    """
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("text")
    found = contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = store(found.where("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct(), "contaminated")
    # the texts that go grow with the corpus, so their keys are not broadcast
    return docs.join(hit.hint("shuffle_merge"), key == F.col("hit"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights are drawn towards even shares.

    Rows with null or empty texts weigh nothing; equal rows share their fate,
    and a null id is drawn by its text.
    """
    return sample(docs.select(*COLUMNS), tempered_targets(power=0.9), budget_share=0.9)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order."""
    return token_sequences(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", tokens_stage),
]

#: SQL can express neither the similarity components over a whole corpus at
#: this size nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
