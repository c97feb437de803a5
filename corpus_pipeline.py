"""The corpus pipeline: language ID, line deduplication, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; :func:`run` writes each result to the shared folder and rereads it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import language_id, line_dedup, ngram_join, packing
from lakeloom.llm.common import remove, settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the model determines with a sufficient score, unchanged."""
    return language_id.keep_determined(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of all texts but the first that has them, and out of the rows the texts that this empties."""
    return line_dedup.remove_boilerplate(docs, drop_emptied=True)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, similarity 0.8)."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", join_ngrams),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # learned weights and best-fit placement are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages keep; a stage's files go once the next has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        made = settle(spark, partial(stage, spark, docs, sf_dir), name)
        if at:
            remove(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
