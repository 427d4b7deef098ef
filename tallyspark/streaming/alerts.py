"""Session alerts over a stream of tool events.

Events carry event_id, event_ts, session_id, event, tool_name, file_hash, start_line,
end_line, content_hash, size_bytes, tool_error and turn. Every function works on a
streaming DataFrame; the stateless ones and the counters also on a batch one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Tool groups and limits of the guards.
READ_TOOLS = ("read_file", "get_errors", "read_notebook_cell_output")
EDIT_TOOLS = (
    "create_file", "replace_string_in_file", "multi_replace_string_in_file", "apply_patch",
    "edit_notebook_file", "insert_edit_into_file",
)
MAX_RESULT_BYTES = 16_000
MAX_ROUNDS = 30
NUDGE_AFTER, NUDGE_EVERY = 20, 10
INSIST_AFTER, INSIST_WINDOW_MS = 2, 600_000
MIN_INTERVENTIONS, FALSE_POSITIVE_RATE = 20, 0.05
SESSION_TTL_MS = 86_400_000

ALERT = "session_id string, event_id long, ts_ms long, rule string, decision string, subject string, value long"


def prepare(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of an event and let state forget events older than `lateness`."""
    keyed = events.withWatermark("event_ts", lateness)
    if events.isStreaming:
        return keyed.dropDuplicatesWithinWatermark(["session_id", "event_id"])
    return keyed.dropDuplicates(["session_id", "event_id"])


def _edit():
    return (F.col("event") == "PostToolUse") & F.col("tool_name").isin(*EDIT_TOOLS) & ~F.coalesce(
        "tool_error", F.lit(False)
    )


def session_counters(events: DataFrame) -> DataFrame:
    """Turns, rounds, edits and compactions per session."""
    count = lambda condition: F.count(F.when(condition, 1))
    return events.groupBy("session_id").agg(
        count(F.col("event") == "UserPromptSubmit").alias("turns"),
        count(F.col("event") == "PostToolUse").alias("rounds"),
        count(_edit()).alias("edits"),
        count(F.col("event") == "PreCompact").alias("compactions"),
    )


def payload_alerts(events: DataFrame) -> DataFrame:
    """Reads of a whole file above the size cap."""
    hit = (
        (F.col("event") == "PreToolUse")
        & F.col("tool_name").isin(*READ_TOOLS)
        & F.col("file_hash").isNotNull()
        & F.col("start_line").isNull()
        & F.col("end_line").isNull()
        & (F.col("size_bytes") > MAX_RESULT_BYTES)
    )
    return events.where(hit).select(
        "session_id",
        "event_id",
        F.unix_millis("event_ts").alias("ts_ms"),
        F.lit("payload-guard").alias("rule"),
        F.lit("rewrite").alias("decision"),
        F.col("file_hash").alias("subject"),
        F.col("size_bytes").cast("long").alias("value"),
    )


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts_ms", "event_id"], kind="stable")


def _keep(state: GroupState, memory: dict, last_ms: int) -> None:
    state.update((json.dumps(memory),))
    state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + SESSION_TTL_MS)


def _reread_step(key, batches, state: GroupState):
    """State of one file in one session: last content per range and recent denials."""
    if state.hasTimedOut:
        state.remove()
        return
    memory = json.loads(state.get[0]) if state.exists else {"seen": {}, "denied": []}
    rows, out = _ordered(batches), []
    for row in rows.itertuples(index=False):
        if row.event == "PostToolUse":
            if row.tool_error:
                memory["seen"] = {}
            continue
        if row.content_hash is None:
            continue
        span = f"{int(row.start)}:{int(row.end)}"
        if memory["seen"].get(span) != row.content_hash:
            memory["seen"][span] = row.content_hash
            continue
        recent = [d for d in memory["denied"] if d[1] >= row.ts_ms - INSIST_WINDOW_MS]
        refusals = sum(d[0] == span for d in recent)
        decision = "yielded" if refusals >= INSIST_AFTER else "deny"
        if decision == "deny":
            recent.append([span, row.ts_ms])
        memory["denied"] = recent
        out.append((key[0], row.event_id, row.ts_ms, "reread-suppressor", decision, f"{key[1]}:{span}", refusals))
    _keep(state, memory, int(rows["ts_ms"].max()))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])


def reread_alerts(events: DataFrame) -> DataFrame:
    """Deny a re-read of unchanged content; yield when the agent insists.

    State is kept per session and file, so a busy session spreads over tasks. A failed
    tool call forgets what was read of its file.
    """
    relevant = ((F.col("event") == "PreToolUse") & F.col("tool_name").isin(*READ_TOOLS)) | (
        (F.col("event") == "PostToolUse") & F.coalesce("tool_error", F.lit(False))
    )
    rows = events.where(relevant & F.col("file_hash").isNotNull()).select(
        "session_id",
        "file_hash",
        "event_ts",
        "event_id",
        F.unix_millis("event_ts").alias("ts_ms"),
        "event",
        "content_hash",
        F.coalesce("tool_error", F.lit(False)).alias("tool_error"),
        F.coalesce("start_line", F.lit(0)).cast("long").alias("start"),
        F.coalesce("end_line", F.lit(0)).cast("long").alias("end"),
    )
    return rows.groupBy("session_id", "file_hash").applyInPandasWithState(
        _reread_step, ALERT, "memory string", "append", GroupStateTimeout.EventTimeTimeout
    )


def _session_step(key, batches, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    memory = (
        json.loads(state.get[0])
        if state.exists
        else {"turns": 0, "rounds": 0, "edits": 0, "compactions": 0, "halted": False}
    )
    rows, out = _ordered(batches), []

    def alert(row, rule, decision, value):
        out.append((key[0], row.event_id, row.ts_ms, rule, decision, None, value))

    for row in rows.itertuples(index=False):
        if row.event == "UserPromptSubmit":
            memory["turns"] += 1
            over = memory["turns"] - NUDGE_AFTER
            if over >= 0 and over % NUDGE_EVERY == 0:
                alert(row, "session-age-nudge", "notify", memory["turns"])
        elif row.event == "PostToolUse":
            memory["rounds"] += 1
            memory["edits"] += int(row.edit)
            if memory["rounds"] >= MAX_ROUNDS and not memory["edits"] and not memory["halted"]:
                memory["halted"] = True
                alert(row, "runaway-halt", "halt", memory["rounds"])
        elif row.event == "PreCompact":
            memory["compactions"] += 1
            if memory["compactions"] > 1:
                alert(row, "compaction-sentinel", "notify", memory["compactions"])
    _keep(state, memory, int(rows["ts_ms"].max()))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])


def session_alerts(events: DataFrame) -> DataFrame:
    """Runaway halts (once), age nudges and repeated compactions."""
    rows = events.where(
        F.col("event").isin("UserPromptSubmit", "PostToolUse", "PreCompact")
    ).select(
        "session_id",
        "event_ts",
        "event_id",
        F.unix_millis("event_ts").alias("ts_ms"),
        "event",
        _edit().alias("edit"),
    )
    return rows.groupBy("session_id").applyInPandasWithState(
        _session_step, ALERT, "memory string", "append", GroupStateTimeout.EventTimeTimeout
    )


def rule_health(decisions: DataFrame) -> DataFrame:
    """Interventions and reversals per rule; a rule overruled too often stands down."""
    health = decisions.groupBy("rule").agg(
        F.count(F.when(F.col("decision").isin("deny", "halt", "rewrite"), 1)).alias("interventions"),
        F.count(F.when(F.col("decision") == "yielded", 1)).alias("reversals"),
    )
    rate = F.when(F.col("interventions") > 0, F.col("reversals") / F.col("interventions"))
    return health.withColumn("reversal_rate", rate).withColumn(
        "disabled",
        (F.col("interventions") >= MIN_INTERVENTIONS)
        & F.coalesce(rate >= FALSE_POSITIVE_RATE, F.lit(False)),
    )


def decision_log(decisions: DataFrame, latest: int = 50) -> DataFrame:
    """The latest decisions."""
    return decisions.orderBy(F.col("ts_ms").desc(), F.col("event_id").desc()).limit(latest)


def spend_windows(requests: DataFrame, kind: str = "day", lateness: str = "1 hour") -> DataFrame:
    """Streaming credits per day, sliding week or session (two-hour gap); late rows drop."""
    ts = F.timestamp_millis("ts")
    rows = requests.withColumn("event_ts", ts).withWatermark("event_ts", lateness)
    if kind == "session":
        keys = [F.session_window("event_ts", "2 hours").alias("span"), F.col("session_id")]
    else:
        span = {"day": ("1 day", "1 day"), "week": ("7 days", "1 day")}[kind]
        keys = [F.window("event_ts", *span).alias("span")]
    return rows.groupBy(*keys).agg(F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("requests"))
