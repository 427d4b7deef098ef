"""Registered queries: the test events as a tool-event stream, run to completion."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..streaming import alerts as A
from ..session import checkpoint_dir
from ..streaming.jobs import collect_stream, ingest_files, read_batches, read_current
from .q_sources import HASH, SALT, journal_lines
from .registry import query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(t):
    raw = t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    key = F.col("event_id")
    m = key % 10
    kind = F.when(m == 0, "UserPromptSubmit").when((m == 1) & (key % 100 == 1), "PreCompact").when(m == 1, "SessionStart").when(m <= 5, "PreToolUse").otherwise("PostToolUse")
    return A.prepare(raw.select(
        key.alias("event_id"), F.col("ts").cast("timestamp").alias("event_ts"), (F.col("user_id") % 40).cast("string").alias("session_id"), kind.alias("event"),
        F.when(m <= 5, "read_file").when(F.col("event_type") == "purchase", F.when(F.col("user_id") % 3 == 0, "apply_patch").otherwise("run")).otherwise("run").alias("tool_name"),
        F.concat(F.lit("f"), key % 3).alias("file_hash"), F.when(key % 4 > 0, 1).alias("start_line"), F.when(key % 4 > 0, 20).alias("end_line"),
        F.concat(F.lit("h"), F.floor(F.col("value") / 40)).alias("content_hash"), (F.col("value") * 400).cast("long").alias("size_bytes"),
        (F.col("event_type") == "error").alias("tool_error")))


SE = dict(se="""SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id % 40 AS VARCHAR) AS session_id,
  CASE WHEN event_id % 10 = 0 THEN 'UserPromptSubmit' WHEN event_id % 100 = 1 THEN 'PreCompact' WHEN event_id % 10 = 1 THEN 'SessionStart' WHEN event_id % 10 <= 5 THEN 'PreToolUse' ELSE 'PostToolUse' END AS event,
  'f' || (event_id % 3) AS file_hash, event_id % 4 = 0 AS whole, 'h' || CAST(floor(value / 40) AS BIGINT) AS content_hash, CAST(trunc(value * 400) AS BIGINT) AS size_bytes,
  event_type = 'purchase' AND user_id % 3 = 0 AND event_id % 10 > 5 AS edit, event_type = 'error' AS failed FROM events""")  # fmt: skip


@query("r01_session_counters", """SELECT session_id, count(*) FILTER (event = 'UserPromptSubmit') AS turns, count(*) FILTER (event = 'PostToolUse') AS rounds,
  count(*) FILTER (edit) AS edits, count(*) FILTER (event = 'PreCompact') AS compactions FROM se GROUP BY 1""", **SE)
def _(t):
    return collect_stream(A.session_counters(stream(t)), "complete")


@query("r02_reread_alerts", """SELECT session_id, event_id, ts_ms, file_hash || CASE WHEN whole THEN ':0:0' ELSE ':1:20' END AS subject FROM (
  SELECT *, lag(content_hash) OVER (PARTITION BY session_id, file_hash, life, whole ORDER BY ts_ms, event_id) AS before FROM (
    SELECT *, count(*) FILTER (event = 'PostToolUse' AND failed) OVER (PARTITION BY session_id, file_hash ORDER BY ts_ms, event_id) AS life FROM se) WHERE event = 'PreToolUse')
WHERE before = content_hash""", **SE)
def _(t):
    return collect_stream(A.reread_alerts(stream(t))).select("session_id", "event_id", "ts_ms", "subject")


@query("r03_payload_alerts", "SELECT session_id, event_id, ts_ms, file_hash AS subject, size_bytes AS value FROM se WHERE event = 'PreToolUse' AND whole AND size_bytes > 16000", **SE)
def _(t):
    return collect_stream(A.payload_alerts(stream(t))).select("session_id", "event_id", "ts_ms", "subject", "value")


RUN = """SELECT *, count(*) OVER w AS rounds, count(*) FILTER (edit) OVER w AS edits FROM se WHERE event = 'PostToolUse' WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id)"""


@query("r04_runaway_alerts", """SELECT session_id, rounds AS value, event_id FROM run WHERE rounds = 30 AND edits = 0""", **SE, run=RUN)
def _(t):
    return collect_stream(A.session_alerts(stream(t))).where(F.col("rule") == "runaway-halt").select("session_id", "value", "event_id")


@query("r05_session_age_nudges", """SELECT session_id, turns AS value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS turns FROM se WHERE event = 'UserPromptSubmit') WHERE turns >= 20 AND turns % 10 = 0""", **SE)
def _(t):
    return collect_stream(A.session_alerts(stream(t))).where(F.col("rule") == "session-age-nudge").select("session_id", "value", "event_id")


@query("r06_compaction_alerts", """SELECT session_id, n AS value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS n FROM se WHERE event = 'PreCompact') WHERE n > 1""", **SE)
def _(t):
    return collect_stream(A.session_alerts(stream(t))).where(F.col("rule") == "compaction-sentinel").select("session_id", "value", "event_id")


@query("r07_insistence")
def _(t):
    return collect_stream(A.reread_alerts(stream(t))).where(F.col("decision") == "yielded").select("session_id", "event_id", "subject", "value")


def decisions(t):
    parts = [collect_stream(f(stream(t))) for f in (A.reread_alerts, A.payload_alerts, A.session_alerts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("r08_rule_health")
def _(t):
    return A.rule_health(decisions(t))


@query("r09_decision_log", """SELECT session_id, event_id, ts_ms, file_hash AS subject FROM se WHERE event = 'PreToolUse' AND whole AND size_bytes > 16000 ORDER BY ts_ms DESC, event_id DESC LIMIT 50""", **SE)
def _(t):
    return A.decision_log(collect_stream(A.payload_alerts(stream(t)))).select("session_id", "event_id", "ts_ms", "subject")


@query("r10_spend_windows", """SELECT epoch_ms(date_trunc('day', ts)) AS day_ms, round(sum(value), 4) AS credits, count(*) AS requests FROM events GROUP BY 1""")
def _(t):
    raw = t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = raw.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("credits"), F.col("user_id").cast("string").alias("session_id"))
    return collect_stream(A.spend_windows(rows), "complete").select(F.unix_millis("span.start").alias("day_ms"), F.round("credits", 4).alias("credits"), "requests")


def journal_store(t):
    """Two ingests of the journals of all customers; those of even customers grow in place between them."""
    lines = journal_lines(t).withColumn("number", F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long"))
    # The first version lacks every third order, the late patch and the unusable lines.
    first = (F.col("offset") == 0) | ((F.col("offset") < 1 << 40) & (F.floor((F.col("offset") - 10) / 10) % 3 != 0))
    root = f"{checkpoint_dir(t.spark)}/ingest-{uuid4().hex}"

    def files(rows, grown):
        text = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(F.col("later"), F.col("offset"), F.col("line")))), lambda x: x["line"]))
        whole = rows.groupBy("path", "number").agg(F.encode(text, "UTF-8").alias("content"))
        mtime = F.timestamp_millis(F.lit(1_000) + F.when(F.lit(grown) & (F.col("number") % 2 == 0), 500).otherwise(0))
        return whole.select("path", mtime.alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content")

    rows = lines.withColumn("later", ~first)
    ingest_files(files(rows.where(~F.col("later")), False), root, SALT, 1)
    ingest_files(files(rows.where(~F.col("later") | (F.col("number") % 2 == 0)), True), root, SALT, 2)
    return root


@query("r10_ingest_current", f"""SELECT CAST(o_orderkey AS VARCHAR) AS request_id, {HASH.format("'s' || o_custkey")} AS session_id, epoch_ms(o_orderdate) AS ts, o_orderkey * 10 AS prompt_tokens, turn_index,
  CASE WHEN o_custkey % 2 = 0 AND turn_index = 0 THEN 6.25::DOUBLE END AS credits, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS version
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, o_orderkey) - 1 AS turn_index FROM orders) WHERE o_orderkey % 9 <> 0 AND (o_orderkey % 3 <> 0 OR o_custkey % 2 = 0)""")
def _(t):
    return read_current(t.spark, journal_store(t), "request").select("request_id", "session_id", "ts", "prompt_tokens", "turn_index", "credits", "version")


@query("r10_ingest_summary", """SELECT 0 AS batch, count(DISTINCT o_custkey) AS files_considered, count(DISTINCT o_custkey) AS files_ingested, 0::BIGINT AS files_skipped, count(*) FILTER (o_orderkey % 3 <> 0) AS requests, 0::BIGINT AS quarantined, 0::BIGINT AS malformed_lines, 0::BIGINT AS unrecognised_envelopes FROM orders
UNION ALL SELECT 1, count(DISTINCT o_custkey), count(DISTINCT o_custkey) FILTER (o_custkey % 2 = 0), count(DISTINCT o_custkey) FILTER (o_custkey % 2 = 1), count(*) FILTER (o_custkey % 2 = 0 AND o_orderkey % 9 <> 0), count(*) FILTER (o_custkey % 2 = 0 AND o_orderkey % 9 = 0),
  count(DISTINCT o_custkey) FILTER (o_custkey % 2 = 0), count(DISTINCT o_custkey) FILTER (o_custkey % 2 = 0) FROM orders""")
def _(t):
    return read_batches(t.spark, journal_store(t), "summary").select("batch", "files_considered", "files_ingested", "files_skipped", "requests", "quarantined", "malformed_lines", "unrecognised_envelopes")
