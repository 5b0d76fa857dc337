"""The corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again for the next.

Rows with null or empty texts pass the first stage as they are; of them, one stays after near-dedup (all texts without
words are one class). A null id is an id like others; rows that share an id are judged by their own texts in every stage
but near-dedup, where they stay if one of them does. Empty tables give empty results; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.common import clear_scratch, documents, scratch_count, stored
from tarnlake.llm.line_dedup import line_dedup
from tarnlake.llm.near_dedup import drop_near_copies
from tarnlake.llm.packing import default_vocabulary, pack
from tarnlake.llm.pii import redact
from tarnlake.llm.toxicity import drop_toxic, fit
from tarnlake.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; all others stay as they are."""
    ship(spark)
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents that lose all of them stay with an empty text."""
    ship(spark)
    return line_dedup(docs).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies."""
    ship(spark)
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind in brackets."""
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    ship(spark)
    return pack(docs, default_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: Trained models, hashes and a tokenizer: SQL can't express them; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each stage's own tables are deleted once its result is written; the last one's input stays until
    clear_scratch is called."""
    docs, before = documents(spark, sf_dir), scratch_count(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_scratch(spark, before, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
