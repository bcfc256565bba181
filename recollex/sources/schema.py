"""Schemas of the tables, never inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

SOURCE = "struct<session_id:string,event_seqs:array<bigint>,excerpt:string>"
AUDIT = "array<struct<action:string,at:timestamp_ntz,by:string,detail:string>>"
MEMORY = (
    "id string, workspace string, session_id string, kind string, content string, content_tokens string, importance double, self_relevance double, tags array<string>, "
    f"source {SOURCE}, dedup_key string, created_at timestamp_ntz, updated_at timestamp_ntz, last_access_at timestamp_ntz, access_count bigint, status string, superseded_by string, supersedes string, audit {AUDIT}, ingested_at timestamp_ntz"
)
VECTOR = "memory_id string, workspace string, dim int, embedding array<float>, embedded_at timestamp_ntz"
EVENT = "session_id string, seq bigint, event_type string, text string, source_kind string, source_plugin string, shadowed_seqs array<bigint>, shadowed_end bigint, provider string, model string, event_time timestamp_ntz, ingested_at timestamp_ntz"
EDGE = f"source_id string, target_id string, relation string, confidence double, created_at timestamp_ntz, source {SOURCE}, audit {AUDIT}"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
