"""The training-corpus pipeline: language, near copies, benchmark leaks, secrets, packing; each stage is written and read again.

Every stage takes rows with nulls in any column, empty and very long texts, equal rows, ties and columns of any further name, and an empty
table, which gives an empty one; its docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import decontaminate, langid, packing, secrets, simhash
from lodestack.llm.common import documents, stored
from lodestack.llm.tokens import default_path

#: Family and language each told no better than by a toss give 0.25.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay: those without text (null, empty) or letters go, and those whose score is MIN_LANGUAGE_SCORE or below.

    Equal rows are judged alike; a null doc_id or lang is only not learned from; long texts are read whole; ties: see langid.
    """
    return langid.keep_identified(docs, langid.fit_on_folds(docs), MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays (word 5-shingles, similarity 0.8): that of the least doc_id, a null one first, then by a hash of the row.

    Candidates come from op6's fingerprints and pigeonhole search, and from min-hash sketches for what its 64 bits do not tell; whole texts decide.
    Texts without words (null, empty, blank) are copies of one another; of rows equal in all columns one stays; long texts are compared whole.
    """
    return simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and an empty benchmark leaves all. Equal rows are judged alike, long texts passage by passage."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays, equal rows alike, a null text as null, a long text searched whole. Values are scored with the words of the rows at hand."""
    return secrets.redact_secrets(docs, words=secrets.learn_words(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of fixed-length sequences; a null or empty text is its end id alone, equal rows are packed each, a long text fills sequences of its own first."""
    return packing.pack(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
#: Language identification, fingerprints, tokens and retrieval are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
