"""From request documents to typed telemetry tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_identifier, hash_path, round_half_up, to_relative_path

# Keys that carry structure, not content, and the depth limit.
STRUCTURAL_KEYS = ("$mid", "type", "ctor", "ctorName", "priority", "flexGrow")
MAX_DEPTH = 64
FILE_DRIFT = "sessionId|requests"

# A value of the wrong JSON type becomes null here, which is how drift is noticed.
REQUEST_JSON = """struct<
 requestId:string, timestamp:double, modelId:string, copilotCredits:double,
 promptTokenDetails:array<struct<category:string,label:string,percentageOfPrompt:double>>,
 response:array<struct<kind:string,uri:struct<fsPath:string,path:string>,edits:array<array<string>>,done:boolean>>,
 contentReferences:array<struct<reference:struct<fsPath:string,path:string,value:struct<fsPath:string,path:string>>>>,
 result:struct<metadata:struct<promptTokens:double,outputTokens:double,resolvedModel:string,
  toolCallRounds:array<struct<id:string,timestamp:double,modelId:string,toolInputRetry:double,thinking:struct<tokens:double>,
   toolCalls:array<struct<id:string,name:string,arguments:string>>>>,
  toolCallResults:map<string,string>,
  summaries:array<struct<toolCallRoundId:string,model:string,numRounds:double,durationMs:double,outcome:string,contextLengthBefore:double>>>>>"""


def _text(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def _leaf_chars(value, depth: int = 0) -> int:
    if depth > MAX_DEPTH:
        return 0
    if isinstance(value, str):
        # Length in UTF-16 units.
        return len(value) + sum(ch > "￿" for ch in value)
    if isinstance(value, list):
        return sum(_leaf_chars(item, depth + 1) for item in value)
    if isinstance(value, dict):
        return sum(_leaf_chars(v, depth + 1) for k, v in value.items() if k not in STRUCTURAL_KEYS)
    return 0


def measure_result_chars(tree: Column) -> Column:
    """Total length of the strings inside a JSON tree; a bare string counts itself."""

    @F.pandas_udf("long")
    def measure(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return _leaf_chars(json.loads(text))
            except ValueError:
                return _leaf_chars(text)

        return texts.map(one, na_action=None).astype("Int64")

    return measure(tree)


def extract_target(arguments: Column, salt: str) -> tuple[Column, Column, Column]:
    """(file hash, start line, end line) named by a tool call's JSON arguments."""
    args = F.from_json(
        arguments,
        "filePath string, file_path string, path string, absolutePath string, uri string, "
        "startLine double, endLine double",
    )
    keys = ("filePath", "file_path", "path", "absolutePath", "uri")
    path = F.coalesce(*[_text(args[key]) for key in keys])
    known = path.isNotNull()
    return (
        hash_path(path, salt),
        F.when(known, args["startLine"]).cast("long"),
        F.when(known, args["endLine"]).cast("long"),
    )


def normalise_requests(replayed: DataFrame, sessions: DataFrame, salt: str) -> DataFrame:
    """Typed requests with a `drift` column naming the first missing field.

    A request without result metadata is incomplete, not drifted, and is left out. A file
    without a session id yields one file-level drift row. Children stay nested in `doc`. Requests that were
    replayed with their session ids are not joined to `sessions`.
    """
    # Exploding a one-element array keeps Spark from reading the document again per column and filter.
    doc = F.explode(F.array(F.from_json("request_json", REQUEST_JSON))).alias("doc")
    if "raw_session_id" not in replayed.columns:
        replayed = replayed.join(sessions.hint("merge"), "path")
    rows = replayed.select("path", "turn_index", "source_offset", "raw_session_id", doc)
    meta = F.col("doc.result.metadata")
    model = _text(F.coalesce(meta["resolvedModel"], F.col("doc.modelId")))
    missing = (
        F.when(F.col("raw_session_id").isNull(), FILE_DRIFT)
        .when(_text(F.col("doc.requestId")).isNull(), "requestId")
        .when(F.col("doc.timestamp").isNull(), "timestamp")
        .when(meta["promptTokens"].isNull(), "result.metadata.promptTokens")
        .when(meta["outputTokens"].isNull(), "result.metadata.outputTokens")
        .when(model.isNull(), "result.metadata.resolvedModel|modelId")
    )
    return rows.where(meta.isNotNull() | F.col("raw_session_id").isNull()).select(
        F.col("doc.requestId").alias("request_id"),
        hash_identifier(F.col("raw_session_id"), salt).alias("session_id"),
        F.col("doc.timestamp").cast("long").alias("ts"),
        model.alias("model"),
        meta["promptTokens"].cast("long").alias("prompt_tokens"),
        meta["outputTokens"].cast("long").alias("output_tokens"),
        F.col("doc.copilotCredits").alias("credits"),
        "turn_index",
        to_relative_path(F.col("path")).alias("source_file"),
        "source_offset",
        missing.alias("drift"),
        "doc",
    )


def file_drift(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Files that hold no recognisable session document."""
    found = sessions.where(F.col("raw_session_id").isNotNull())
    return files.select("path").distinct().join(found.hint("merge"), "path", "left_anti").withColumn(
        "drift", F.lit(FILE_DRIFT)
    )


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("drift").isNull())


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("drift").isNotNull()).select("source_file", "turn_index", "drift")


def all_drift(rows: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Drift of requests, and one row without a turn for each file that holds no session."""
    whole = file_drift(sessions, files).select(
        to_relative_path(F.col("path")).alias("source_file"), F.lit(None).cast("long").alias("turn_index"), "drift"
    )
    return quarantine(rows).where(F.col("drift") != FILE_DRIFT).unionByName(whole)


def explode_cost_centres(rows: DataFrame) -> DataFrame:
    """Well-formed entries; labels nobody has seen before are kept."""
    c = F.col("c")
    ok = _text(c["category"]).isNotNull() & _text(c["label"]).isNotNull() & c["percentageOfPrompt"].isNotNull()
    return (
        rows.select("request_id", "prompt_tokens", F.explode("doc.promptTokenDetails").alias("c"))
        .where(ok)
        .select(
            "request_id",
            c["category"].alias("category"),
            c["label"].alias("label"),
            c["percentageOfPrompt"].alias("percentage_of_prompt"),
            round_half_up(c["percentageOfPrompt"] / 100 * F.col("prompt_tokens")).alias("tokens"),
        )
    )


def _rounds(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    return rows.select(
        "request_id",
        F.col("doc.result.metadata.toolCallResults").alias("results"),
        F.explode("doc.result.metadata.toolCallRounds").alias("r"),
    ).where(_text(r["id"]).isNotNull() & r["timestamp"].isNotNull())


def explode_rounds(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    return _rounds(rows).select(
        "request_id",
        r["id"].alias("round_id"),
        r["timestamp"].cast("long").alias("ts"),
        _text(r["modelId"]).alias("model_id"),
        r["thinking"]["tokens"].cast("long").alias("thinking_tokens"),
        F.coalesce(r["toolInputRetry"], F.lit(0)).cast("long").alias("retries"),
    )


def explode_tool_calls(rows: DataFrame, salt: str) -> DataFrame:
    c = F.col("c")
    file_hash, start, end = extract_target(_text(c["arguments"]), salt)
    return (
        _rounds(rows)
        .select("request_id", F.col("r.id").alias("round_id"), "results", F.explode("r.toolCalls").alias("c"))
        .where(_text(c["id"]).isNotNull() & _text(c["name"]).isNotNull())
        .select(
            "request_id",
            "round_id",
            c["id"].alias("tool_call_id"),
            c["name"].alias("name"),
            measure_result_chars(F.try_element_at("results", c["id"])).alias("result_chars"),
            file_hash.alias("target_file_hash"),
            start.alias("target_start_line"),
            end.alias("target_end_line"),
        )
    )


def explode_compactions(rows: DataFrame) -> DataFrame:
    s = F.col("s")
    out = rows.select("request_id", F.explode("doc.result.metadata.summaries").alias("s")).select(
        "request_id",
        _text(s["toolCallRoundId"]).alias("tool_call_round_id"),
        _text(s["model"]).alias("model"),
        s["numRounds"].cast("long").alias("num_rounds"),
        s["durationMs"].cast("long").alias("duration_ms"),
        _text(s["outcome"]).alias("outcome"),
        s["contextLengthBefore"].cast("long").alias("context_length_before"),
    )
    return out.dropna(subset=out.columns[1:])


def explode_edits(rows: DataFrame, salt: str) -> DataFrame:
    e = F.col("e")
    path = _text(F.coalesce(e["uri"]["fsPath"], e["uri"]["path"]))
    batches = F.aggregate(
        F.coalesce(e["edits"], F.array().cast("array<array<string>>")),
        F.lit(0).cast("long"),
        lambda total, batch: total + F.greatest(F.coalesce(F.size(batch), F.lit(0)), F.lit(0)),
    )
    return (
        rows.select("request_id", F.explode("doc.response").alias("e"))
        .where((e["kind"] == "textEditGroup") & path.isNotNull())
        .groupBy("request_id", hash_path(path, salt).alias("file_hash"))
        .agg(F.sum(batches).alias("edit_count"), F.bool_or(F.coalesce(e["done"], F.lit(False))).alias("done"))
    )


def explode_content_references(rows: DataFrame, salt: str) -> DataFrame:
    ref = F.col("c.reference")
    path = F.when(
        ref["value"].isNotNull(), _text(F.coalesce(ref["value"]["fsPath"], ref["value"]["path"]))
    ).otherwise(_text(F.coalesce(ref["fsPath"], ref["path"])))
    return (
        rows.select("request_id", F.explode("doc.contentReferences").alias("c"))
        .where(path.isNotNull())
        .select("request_id", hash_path(path, salt).alias("file_hash"))
        .distinct()
    )


def child_tables(rows: DataFrame, salt: str) -> dict[str, DataFrame]:
    return {
        "request": rows.drop("doc", "drift"),
        "cost_centre": explode_cost_centres(rows),
        "round": explode_rounds(rows),
        "tool_call": explode_tool_calls(rows, salt),
        "edit": explode_edits(rows, salt),
        "compaction": explode_compactions(rows),
        "content_reference": explode_content_references(rows, salt),
    }
