"""Corpus pipeline: raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept;
its result is written as Parquet to the shared folder and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``.  An empty table
gives an empty result; nulls, ties and repeated rows are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.sizing import shared_folder
from tabloom.llm import bpe, mixing, pii, repetition, simhash
from tabloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id."""
    return simhash.keep_one_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of source, language and topic."""
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return bpe.token_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", redact),
    ("source_mixing", mix),
    ("bpe", encode),
]

# Sampling by fitted probabilities and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
