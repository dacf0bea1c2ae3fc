"""Table schemas of the message store and the thresholds that are part of its semantics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TIME_POINT = "struct<type:string,time:string,label:string>"
DDL = {
    "messages": "source string, msg_id string, session_id string, group_name string, sender_id string, sender_name string, content string, timestamp long, is_self boolean, image_urls array<string>, article_url string",
    "raw_messages": "source string, msg_id string, session_id string, group_name string, sender_id string, sender_name string, content string, timestamp long, article_url string",
    "sessions": "source string, session_id string, name string, is_group int, is_official int, enabled int, last_seen string, last_active long, last_poll_ts long",
    "contacts": "source string, sender_id string, display_name string",
    "items": f"id string, category string, title string, key_info string, sender_name string, source_quote string, source_group string, subject string, source string, source_msg_id string, session_id string, msg_time long, is_verified int, verified_at string, content_hash string, image_urls array<string>, article_url string, start string, end string, remind_at string, extra_times array<{TIME_POINT}>, created_at string",
    "categories": "id long, name string, prompt string, color string, enabled int, created_at string",
    "processed_messages": "source string, msg_id string, processed_at string",
    "item_embeddings": "item_id string, model string, embedding array<float>, created_at string",
    "recat_log": "id long, item_id string, source string, source_msg_id string, category_before string, category_after string, content string, created_at string",
    "filter_state": "source string, msg_id string, uncertain_count int, adapter_version string, updated_at string",
    "rag_chunks": "source string, msg_id string, session_id string, group_name string, sender_name string, msg_time long, content string, item_id string",
    "rag_chunk_embeddings": "source string, msg_id string, model string, embedding array<float>, created_at string",
    "rag_skipped": "source string, msg_id string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table]) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(DDL[table])


@dataclass(frozen=True)
class Settings:
    """Thresholds of the decisions; the defaults are part of the semantics."""

    dedup_overlap: float = 0.07
    dedup_cosine: float = 0.80
    dedup_fallback: float = 0.65
    dedup_strong: float = 0.99
    dedup_top_k: int = 3
    merge_window_s: int = 600
    merge_candidates: int = 3
    merge_prefilter: float = -1.0
    poll_overlap_s: int = 300
    backfill_hours: int = 24
    rag_top_k: int = 12
    rag_keyword_limit: int = 12
    rag_evidence: int = 10
    rag_evidence_chars: int = 600
    rag_refusal: float = 0.25
    rag_min_cosine: float = 0.05
    rag_backfill_days: int = 7
    rag_budget: int = 2000
    fusion_k: int = 60


def schema_differences(df: DataFrame, table: str) -> dict[str, list[str]]:
    """Columns that are missing, extra or of another type than the table's schema; all empty when they agree."""
    want = {f.name: f.dataType.simpleString() for f in schema(table)}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return {
        "missing": sorted(want.keys() - have.keys()),
        "extra": sorted(have.keys() - want.keys()),
        "type": sorted(c for c in want.keys() & have.keys() if want[c] != have[c]),
    }
