"""Corpus pipeline: documents are identified, judged, deduplicated, mixed and packed, one stage after another.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; the last returns pieces of packed sequences. SQL cannot express the stages; tests/llm holds them against
brute force. Every stage keeps an empty table empty, judges repeated rows as rows, and passes columns of any name on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillspark.llm import jaccard, kneserney, language, mixing, packing
from rillspark.llm.cluster import stored
from rillspark.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known with a share of 0.4 at least; null texts and texts without a letter go."""
    return language.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is at most their language's threshold; rows without words go."""
    return kneserney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, five words and 0.8: that of the smallest id. Null ids stay only
    where their component has no other row; rows without words stay, of equal ones one."""
    return jaccard.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, in the order of finish times; rows without words are never taken."""
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; null text counts as empty and has its end token only."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: The stages learn from data, follow links and plan windows: there is no SQL for their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
