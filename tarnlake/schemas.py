"""Schemas of the collections, with the default of each field that may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE = "file_path string, file_size_bytes bigint, file_name string, file_type string"
TIMES = "created_at timestamp, updated_at timestamp"

DDL = {
    "knowledges": f"_id string, name string, description string, select_training boolean, document_count bigint, total_size_bytes bigint, {TIMES}",
    "documents": f"_id string, knowledge_id string, title string, description string, document_type string, priority_diabetes double, is_active boolean, file_hash string, {FILE}, {TIMES}",
    "document_jobs": f"_id string, document_id string, knowledge_id string, title string, description string, type string, processing_status struct<status:string,progress:double,progress_message:string>, file struct<file_path:string,file_size_bytes:bigint,file_name:string,file_type:string>, priority_diabetes double, document_status string, {TIMES}",
    "document_chunks": f"_id string, document_id string, knowledge_id string, content string, diabetes_score double, is_active boolean, {TIMES}",
    "chat_sessions": f"_id string, user_id string, title string, external_knowledge boolean, {TIMES}",
    "chat_histories": f"_id string, session_id string, user_id string, content string, role string, {TIMES}",
    "settings": "_id string, top_k int, search_accuracy double, temperature double, max_tokens int, list_knowledge_ids array<string>",
    "user_profiles": f"_id string, user_id string, patient_id string, full_name string, age int, gender string, bmi double, diabetes_type string, insulin_schedule string, treatment_method string, complications array<string>, past_diseases array<string>, lifestyle string, {TIMES}",
    "health_records": f"_id string, user_id string, patient_id string, type string, value double, unit string, subtype string, timestamp timestamp, {TIMES}",
    "points": "id string, knowledge_id string, embedding array<float>, payload struct<content:string,metadata:struct<document_chunk_id:string,document_id:string,knowledge_id:string,is_active:boolean>,document_is_active:boolean>",
}

DEFAULTS = {
    "knowledges": {"select_training": False, "document_count": 0, "total_size_bytes": 0},
    "documents": {"priority_diabetes": 0.0, "is_active": True},
    "document_jobs": {"priority_diabetes": 0.0, "document_status": "normal"},
    "document_chunks": {"diabetes_score": 0.0, "is_active": True},
    "settings": {"top_k": 5, "search_accuracy": 0.7, "temperature": 0.5, "max_tokens": 1000, "list_knowledge_ids": []},
}

ENUMS = {
    "job_status": ["pending", "processing", "completed", "failed"],
    "document_status": ["normal", "deleted", "duplicate"],
    "document_type": ["uploaded", "training", "trained"],
    "role": ["user", "ai"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def literal(value) -> Column:
    return F.array().cast("array<string>") if value == [] else F.lit(value)


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the collection's schema: columns cast, missing ones added, nulls replaced by the field's default."""
    defaults = DEFAULTS.get(name, {})
    out = []
    for f in schema(name):
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, literal(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    return df.select(*out)


def flatten(df: DataFrame, *structs: str) -> DataFrame:
    """Fields of the structs as columns of their own, in place of the structs."""
    return df.select(*[c for c in df.columns if c not in structs], *[f"{s}.*" for s in structs])


def with_file_struct(df: DataFrame) -> DataFrame:
    """Jobs in any older layout (nested file, nested `path`, flat columns) with a complete `file`."""

    def first(*paths: str) -> Column:
        have = [F.col(p) for p in paths if _has(df, p)]
        return F.coalesce(*have) if have else F.lit(None)

    path = F.coalesce(first("file.file_path", "file.path", "file_path").cast("string"), F.lit(""))
    size = F.coalesce(first("file.file_size_bytes", "file.size", "file_size_bytes").cast("bigint"), F.lit(0).cast("bigint"))
    name = F.coalesce(first("file.file_name", "file.name", "file_name").cast("string"), F.lit(""))
    kind = F.coalesce(first("file.file_type", "file.type", "file_type").cast("string"), F.lit(""))
    made = F.struct(path.alias("file_path"), size.alias("file_size_bytes"), name.alias("file_name"), kind.alias("file_type"))
    return df.withColumn("file", made)


def _has(df: DataFrame, path: str) -> bool:
    at = df.schema
    for part in path.split("."):
        if not isinstance(at, StructType) or part not in at.names:
            return False
        at = at[part].dataType
    return True


#: Columns that each listing returns, by collection.
DTO = {
    "documents": ["_id", "knowledge_id", "title", "description", "document_type", "priority_diabetes", "is_active", "file_size_bytes", "file_name", "file_type", "updated_at"],
    "document_chunks": ["_id", "document_id", "knowledge_id", "content", "diabetes_score", "is_active", "created_at", "updated_at"],
    "knowledges": ["_id", "name", "description", "select_training", "document_count", "total_size_bytes", "updated_at"],
    "chat_sessions": ["_id", "user_id", "title", "created_at", "updated_at"],
    "chat_histories": ["_id", "session_id", "user_id", "content", "role", "created_at", "updated_at"],
    "settings": ["top_k", "search_accuracy", "temperature", "max_tokens"],
}


def dto(df: DataFrame, name: str) -> DataFrame:
    return df.select(*DTO[name])
