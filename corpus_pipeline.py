"""A training-data pipeline: each stage is one operator over all that its predecessor kept.

Stages but the last return the columns of documents; every stage's result is written as Parquet and read again as the
next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kumiki.llm import decontaminate, exact_dedup, jaccard_join, toxicity
from kumiki.llm.bpe import bpe
from kumiki.llm.queries import tokenizer_file
from kumiki.llm.shared import released, table, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the last model of the chain rejects go."""
    return toxicity.fit_rows(docs, toxicity.with_categories(table(spark, sf_dir, "labels")))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup_rows(docs, keep="largest")


def stage_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text."""
    out = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe(docs, tokenizer_file("word_bpe_49k.json"), "words", outputs=out)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("jaccard_join", stage_jaccard_join),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]

#: No SQL: models and a tokenizer take part. tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = released(written(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
