"""Pipeline over ``documents``: language, repetition, copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
``docs``.  All but the last return the columns of ``docs``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exactdedup, langid, ngramjoin, packing, quality
from weftline.llm.queries import END_TOKEN, SEQUENCE_TOKENS, table, word_tokenizer
from weftline.runtime import configure, scratch_path, write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that text, declaration and source settle go."""
    configure(spark)
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves go."""
    configure(spark)
    return quality.keep_clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    configure(spark)
    return exactdedup.drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest id stays."""
    configure(spark)
    return ngramjoin.one_per_component(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes token pieces with a place in a sequence."""
    configure(spark)
    return packing.packed_documents(docs, word_tokenizer(), SEQUENCE_TOKENS, END_TOKEN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("best_fit_packing", best_fit_packing),
]

# Tokenizer, trained model and connected components have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), scratch_path(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
