"""A corpus from raw documents to packed sequences, stage by stage over Parquet tables.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but
the last return the columns of documents. No stage reads anything but ``docs``.

A document without text (null or empty) has no words and no language: the first two stages drop
it. Of rows with equal texts one stays, that with the largest doc_id (null is the smallest), of
repeated rows one; of near-duplicates the one with the smallest doc_id and text hash. Documents
of any length are worked on whole. An empty table passes through as an empty one. Further columns
are carried along, whatever their names, but for the last stage, which returns places of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import common, exact, langid, ngram_join, packing, quality

#: A document stays if its language has at least this posterior.
LANGUAGE_SCORE = 0.5

#: Units that a worker remembers while encoding: its memory also holds what earlier stages left.
UNITS = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; ``und`` and uncertain ones go."""
    return langid.keep(docs, langid.learn_from(docs), LANGUAGE_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the remaining documents in the packed sequences."""
    return packing.pack(docs, units=UNITS)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The learned language model and the tokenizer are outside SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
