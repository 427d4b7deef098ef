"""Normalised telemetry tables. Times are epoch milliseconds; null credits mean unmeasured."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


INGESTED_FILE = _table(
    file_path="string", mtime_ms="long", size_bytes="long", content_hash="string",
    last_ingested_at="long",
)
SESSION = _table(session_id="string", first_seen_at="long", last_seen_at="long")
REQUEST = _table(
    request_id="string", session_id="string", ts="long", model="string", prompt_tokens="long",
    output_tokens="long", credits="double", turn_index="long", source_file="string",
    source_offset="long",
)
COST_CENTRE = _table(
    request_id="string", category="string", label="string", percentage_of_prompt="double",
    tokens="long",
)
ROUND = _table(
    request_id="string", round_id="string", ts="long", model_id="string", thinking_tokens="long",
    retries="long",
)
TOOL_CALL = _table(
    request_id="string", round_id="string", tool_call_id="string", name="string",
    result_chars="long", target_file_hash="string", target_start_line="long",
    target_end_line="long",
)
EDIT = _table(request_id="string", file_hash="string", edit_count="long", done="boolean")
COMPACTION = _table(
    request_id="string", tool_call_round_id="string", model="string", num_rounds="long",
    duration_ms="long", outcome="string", context_length_before="long",
)
CONTENT_REFERENCE = _table(request_id="string", file_hash="string")

TABLES = {
    "ingested_file": INGESTED_FILE,
    "session": SESSION,
    "request": REQUEST,
    "cost_centre": COST_CENTRE,
    "round": ROUND,
    "tool_call": TOOL_CALL,
    "edit": EDIT,
    "compaction": COMPACTION,
    "content_reference": CONTENT_REFERENCE,
}
