"""Sequences of tool events with known alerts."""

from datetime import datetime, timedelta, timezone

from tallyspark.streaming import alerts as A
from tallyspark.streaming.jobs import collect_stream

SCHEMA = (
    "event_id long, event_ts timestamp, session_id string, event string, tool_name string, file_hash string, "
    "start_line long, end_line long, content_hash string, size_bytes long, tool_error boolean, turn long"
)


def event(i, minute, kind, tool=None, file=None, content=None, error=False, size=10):
    ts = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minute)
    return (i, ts, "s", kind, tool, file, None, None, content, size, error, 0)


def run(spark, tmp_path, batches, build):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return sorted(collect_stream(build(A.prepare(stream))).collect(), key=lambda r: r["event_id"])


def test_reread_denied_until_the_agent_insists(spark, tmp_path):
    read = lambda i, m, c: event(i, m, "PreToolUse", "read_file", "f", c)
    rows = [read(1, 0, "a"), read(2, 1, "a"), read(3, 2, "a"), read(4, 3, "a"), read(5, 14, "a"), read(6, 15, "b")]
    rows += [event(7, 16, "PostToolUse", "run", "f", error=True), read(8, 17, "b"), read(1, 0, "a")]
    got = run(spark, tmp_path, [rows[:3], rows[3:]], A.reread_alerts)
    assert [(r["event_id"], r["decision"]) for r in got] == [(2, "deny"), (3, "deny"), (4, "yielded"), (5, "deny")]


def test_runaway_halts_once(spark, tmp_path):
    rounds = [event(i, i, "PostToolUse", "run") for i in range(1, 41)]
    got = run(spark, tmp_path, [rounds[:25], rounds[25:]], A.session_alerts)
    assert [(r["event_id"], r["rule"]) for r in got] == [(30, "runaway-halt")]


def test_an_edit_prevents_the_halt_unless_it_failed(spark, tmp_path):
    rounds = [event(i, i, "PostToolUse", "run") for i in range(1, 35)]
    ok = [*rounds, event(99, 0, "PostToolUse", "apply_patch")]
    assert run(spark, tmp_path / "ok", [ok], A.session_alerts) == []
    bad = [*rounds, event(99, 0, "PostToolUse", "apply_patch", error=True)]
    assert len(run(spark, tmp_path / "bad", [bad], A.session_alerts)) == 1


def test_rule_stands_down_when_overruled(spark):
    rows = [("r", "deny")] * 20 + [("r", "yielded")] + [("q", "deny")] * 19 + [("q", "yielded")] * 5
    health = {h["rule"]: h for h in A.rule_health(spark.createDataFrame(rows, "rule string, decision string")).collect()}
    assert health["r"]["disabled"] and not health["q"]["disabled"]
