"""Ingestion and training of documents as one lazy plan per result table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.registry import embedder, sentence_encoder
from tarnlake.functions.text import base_name, extension, inject_tables
from tarnlake.operators.chunking import chunk_documents
from tarnlake.operators.scoring import relevance
from tarnlake.sources.files import marked_lines, parse_files
from tarnlake.streaming.jobs import dedupe_contents

Embed = Callable[[Column], Column]


def stable_id(*parts: Column) -> Column:
    """An id of 24 hexadecimal digits that a run again gives again, so that writes may be repeated."""
    return F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 24)


def points_of(chunks: DataFrame, embed: Embed) -> DataFrame:
    """Vector points of chunks (_id, document_id, knowledge_id, content, is_active), keyed by chunk."""
    meta = F.struct(F.col("_id").alias("document_chunk_id"), "document_id", "knowledge_id", F.lit(True).alias("is_active"))
    payload = F.struct("content", meta.alias("metadata"), F.lit(True).alias("document_is_active"))
    return chunks.select(F.col("_id").alias("id"), "knowledge_id", embed(F.col("content")).alias("embedding"), payload.alias("payload"))


def ingest(files: DataFrame, known: DataFrame, knowledge_id: str, embed: Embed | None = None, score: Callable[[Column], Column] = relevance, **chunking) -> dict[str, DataFrame]:
    """New rows of documents, document_chunks and points from files (path, content, length), with duplicates and failed.

    Content that known documents (file_hash) or an earlier file have is a duplicate. What can't be parsed is in failed,
    with its error; it stops no other file. Nothing runs until a result is written. Options go to chunk_documents;
    without a sentence encoder in `load`, hash_vector finds where neighbouring sentences differ.
    """
    new, duplicates = dedupe_contents(files, known)
    parsed = parse_files(new, ("file_hash", "length"))
    good = parsed.filter("error is null").withColumn("document_id", stable_id(F.lit(knowledge_id), F.col("file_hash")))
    texts = good.select("document_id", inject_tables(marked_lines(F.col("content")), F.col("tables")).alias("text"))
    pieces = chunk_documents(texts, id_col="document_id", **{"load": sentence_encoder, "min_tokens": 50, "threshold": 0.7} | chunking)
    chunks = pieces.select(
        stable_id(F.col("document_id"), F.col("chunk_index").cast("string")).alias("_id"), "document_id", F.lit(knowledge_id).alias("knowledge_id"),
        "content", score(F.col("content")).alias("diabetes_score"), F.lit(True).alias("is_active"),
    )
    means = chunks.groupBy("document_id").agg(F.avg("diabetes_score").alias("mean"))
    documents = good.join(means, "document_id", "left").select(
        F.col("document_id").alias("_id"), F.lit(knowledge_id).alias("knowledge_id"), base_name(F.col("path")).alias("title"), F.lit("uploaded").alias("document_type"),
        F.coalesce("mean", F.lit(0.0)).alias("priority_diabetes"), F.lit(True).alias("is_active"), "file_hash", F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"), base_name(F.col("path")).alias("file_name"), extension(F.col("path")).alias("file_type"),
    )
    return {"documents": documents, "document_chunks": chunks, "points": points_of(chunks, embed or embedder()), "duplicates": duplicates, "failed": parsed.filter("error is not null").select("path", "error")}


def train(chunks: DataFrame, points: DataFrame, document_ids: list[str], embed: Embed | None = None) -> DataFrame:
    """Points of the documents' active chunks that have none yet."""
    mine = chunks.filter(F.col("document_id").isin(document_ids) & F.col("is_active"))
    have = points.select(F.col("payload.metadata.document_chunk_id").alias("_id"))
    return points_of(mine.join(have, "_id", "left_anti"), embed or embedder())
