"""Changes of collections, each as the new version of its table; sources.tables stores versions.

Parquet tables know no UPDATE, DELETE or MERGE, so a change is a plan over the old version: when() for updates, an
anti-join for deletes, an anti-join with a union for upserts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument
from tarnlake.operators.predicates import equals
from tarnlake.operators.relational import absent_from, collection_stats, insertable, sync_status


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new rows in place of old ones with their keys; new keys are unique."""
    return absent_from(old, new, key).unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with those new rows whose key it hasn't ($setOnInsert)."""
    return old.unionByName(absent_from(new, old, key), allowMissingColumns=True)


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """Columns set to values (constants or columns) where the condition holds; None leaves a column as it is."""
    put = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items() if v is not None}
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in put.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_points(points: DataFrame, **conditions) -> DataFrame:
    if not conditions:
        raise InvalidArgument("NO_CONDITION", "deleting points needs a condition")
    return delete(points, equals(**conditions))


def set_payload(points: DataFrame, values: dict[str, object], point_id: str | None = None, **conditions) -> DataFrame:
    """Payload fields (dotted) set for a point or for all points that match."""
    if point_id is None and not conditions:
        raise InvalidArgument("NO_CONDITION", "updating payloads needs a point or a condition")
    where = F.col("id") == point_id if point_id is not None else equals(**conditions)
    payload = F.col("payload")
    for k, v in values.items():
        payload = payload.withField(k, F.lit(v))
    return points.withColumn("payload", F.when(where, payload).otherwise(F.col("payload")))


def create_documents(jobs: DataFrame, documents: DataFrame, new: DataFrame) -> DataFrame:
    """jobs with one pending job for each new document (knowledge_id, title, ...) whose title is new to its base, in table and batch."""
    titles = ["knowledge_id", "title"]
    fresh = absent_from(insertable(new, documents, titles), jobs.filter("document_status = 'normal'"), titles)
    status = F.struct(F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), F.lit("").alias("progress_message"))
    return jobs.unionByName(fresh.withColumns({"type": F.lit("upload_document"), "processing_status": status, "document_status": F.lit("normal")}), allowMissingColumns=True)


def update_document(documents: DataFrame, points: DataFrame, document_id: str, title: str | None = None, description: str | None = None, is_active: bool | None = None) -> tuple[DataFrame, DataFrame]:
    out = update(documents, F.col("_id") == document_id, title=title, description=description, is_active=is_active)
    if is_active is not None:
        points = set_payload(points, {"document_is_active": is_active}, payload__metadata__document_id=document_id)
    return out, points


def toggle_chunks(chunks: DataFrame, points: DataFrame, ids: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """is_active of the chunks negated, and copied to their points."""
    if isinstance(ids, DataFrame):
        marked = chunks.join(ids.select(F.col("_id").alias("_hit")).distinct(), F.col("_id") == F.col("_hit"), "left")
        out = marked.withColumn("is_active", F.when(F.col("_hit").isNotNull(), ~F.col("is_active")).otherwise(F.col("is_active")))
        changed = out.filter("_hit is not null")
        return out.drop("_hit"), sync_status(points, changed)
    where = F.col("_id").isin(ids)
    out = chunks.withColumn("is_active", F.when(where, ~F.col("is_active")).otherwise(F.col("is_active")))
    return out, sync_status(points, out.filter(where))


def delete_document(tables: dict[str, DataFrame], document_id: str) -> dict[str, DataFrame]:
    """New versions of documents, document_chunks, points, document_jobs and knowledges (its statistics counted anew)."""
    new = dict(tables)
    new["documents"] = delete(tables["documents"], F.col("_id") == document_id)
    new["document_chunks"] = delete(tables["document_chunks"], F.col("document_id") == document_id)
    new["points"] = delete_points(tables["points"], payload__metadata__document_id=document_id)
    new["document_jobs"] = update(tables["document_jobs"], F.col("document_id") == document_id, document_status="deleted")
    new["knowledges"] = recount(tables["knowledges"], new["documents"])
    return new


def recount(knowledges: DataFrame, documents: DataFrame) -> DataFrame:
    stats = collection_stats(documents).withColumnsRenamed({"knowledge_id": "_k", "document_count": "_n", "total_size_bytes": "_b"})
    joined = knowledges.join(stats, F.col("_id") == F.col("_k"), "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({"document_count": F.coalesce("_n", zero), "total_size_bytes": F.coalesce("_b", zero)}).drop("_k", "_n", "_b")


def create_knowledge(knowledges: DataFrame, new: DataFrame) -> DataFrame:
    return knowledges.unionByName(insertable(new, knowledges, ["name"]), allowMissingColumns=True)


def update_knowledge(knowledges: DataFrame, knowledge_id: str, **values) -> DataFrame:
    return update(knowledges, F.col("_id") == knowledge_id, **values)


def delete_knowledge(tables: dict[str, DataFrame], knowledge_id: str) -> dict[str, DataFrame]:
    """New versions of every table with a trace of the knowledge base: its rows go, the settings forget its id."""
    new = dict(tables)
    new["knowledges"] = delete(tables["knowledges"], F.col("_id") == knowledge_id)
    for name in ("documents", "document_chunks", "document_jobs", "points"):
        new[name] = delete(tables[name], F.col("knowledge_id") == knowledge_id)
    new["settings"] = tables["settings"].withColumn("list_knowledge_ids", F.array_remove("list_knowledge_ids", knowledge_id))
    return new


def files_of_knowledge(jobs: DataFrame, knowledge_id: str) -> DataFrame:
    """bucket and object of each file to delete with a knowledge base."""
    from tarnlake.functions.text import bucket_of, object_of

    path = F.col("file.file_path")
    return jobs.filter(F.col("knowledge_id") == knowledge_id).select(bucket_of(path).alias("bucket"), object_of(path).alias("object"))


def update_settings(settings: DataFrame, knowledges: DataFrame, ids: list[str] | None = None, **values) -> tuple[DataFrame, DataFrame]:
    """Settings with the values given, and knowledges of which exactly the listed ones are selected for training."""
    new = settings.withColumns({k: F.lit(v).cast(settings.schema[k].dataType) for k, v in values.items() if v is not None})
    if ids is None:
        return new, knowledges
    chosen = F.array(*map(F.lit, ids)).cast("array<string>")
    return new.withColumn("list_knowledge_ids", chosen), knowledges.withColumn("select_training", F.array_contains(chosen, F.col("_id")))


def create_session(sessions: DataFrame, new: DataFrame) -> DataFrame:
    return sessions.unionByName(insertable(new, sessions, ["user_id", "title"]), allowMissingColumns=True)


def update_session(sessions: DataFrame, session_id: str, title: str | None = None, external_knowledge: bool | None = None) -> DataFrame:
    return update(sessions, F.col("_id") == session_id, title=title, external_knowledge=external_knowledge)


def delete_session(sessions: DataFrame, messages: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    return delete(sessions, F.col("_id") == session_id), delete(messages, F.col("session_id") == session_id)


def append_messages(messages: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones; their sessions' updated_at moves to the newest of them."""
    touched = new.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    joined = sessions.join(touched, F.col("_id") == F.col("session_id"), "left").drop("session_id")
    moved = joined.withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    return messages.unionByName(new, allowMissingColumns=True), moved


def delete_user_messages(messages: DataFrame, user_id: str) -> DataFrame:
    return delete(messages, F.col("user_id") == user_id)


def add_training_jobs(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """jobs with a pending training job for each document that has none."""
    new = documents.select(F.col("_id").alias("document_id"), "knowledge_id", "title", F.lit("training_document").alias("type"))
    new = absent_from(new, jobs.filter("type = 'training_document'"), ["document_id"])
    status = F.struct(F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), F.lit("").alias("progress_message"))
    return jobs.unionByName(new.withColumn("processing_status", status), allowMissingColumns=True)


def add_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    return profiles.unionByName(insertable(new, profiles, ["user_id"]), allowMissingColumns=True)


def add_readings(readings: DataFrame, new: DataFrame) -> DataFrame:
    """Readings with the new ones of values from 0; subtypes are stored in lower case."""
    kept = new.filter("value >= 0").withColumn("subtype", F.lower("subtype"))
    return readings.unionByName(kept, allowMissingColumns=True)
