"""Journals from files to tables, in one go and as a stream."""

import json
import os
import random
from urllib.parse import unquote

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.sources import journals as J
from tallyspark.sources import normalise as N
from tallyspark.streaming.jobs import ingest_journals, read_batches, read_current

SALT = "salt"


def request(i, **over):
    meta = {
        "promptTokens": 8_640, "outputTokens": 310,
        "toolCallRounds": [{"id": "rd", "timestamp": 5, "thinking": {"tokens": 27},
                            "toolCalls": [{"id": "c", "name": "read_file", "arguments": '{"filePath":"/A.py","startLine":1}'}]}],
        "toolCallResults": {"c": {"type": "skip me", "content": ["abc", {"value": "de"}]}},
        "summaries": [{"toolCallRoundId": "rd", "model": "m", "numRounds": 9, "durationMs": 41500, "outcome": "ok", "contextLengthBefore": 77000}],
    }
    edits = [{"kind": "textEditGroup", "uri": {"fsPath": "/A.py"}, "edits": [[{"text": "x"}]], "done": done} for done in (False, True)]
    base = {
        "requestId": f"q{i}", "timestamp": 1000 + i, "modelId": "gpt", "response": edits,
        "promptTokenDetails": [{"category": "c", "label": "Files", "percentageOfPrompt": 5}, {"label": "bad"}],
        "contentReferences": [{"reference": {"value": {"fsPath": "/A.py"}}}, {"reference": {"fsPath": "/a.py"}}],
        "result": {"metadata": meta},
    }
    base.update(over)
    return base


def journal(tmp_path, *lines, name="a.jsonl", ending="\n"):
    folder = tmp_path / "workspaceStorage" / "ws1" / "chatSessions"
    folder.mkdir(parents=True, exist_ok=True)
    text = ending.join(line if isinstance(line, str) else json.dumps(line) for line in lines)
    (folder / name).write_bytes(text.encode())
    return str(tmp_path / "workspaceStorage")


def tables(spark, root):
    envelopes = J.parse_envelopes(J.split_lines(J.scan_journals(spark, ["/nowhere", root])))
    rows = N.normalise_requests(J.replay_journal(envelopes), J.session_ids(envelopes), SALT)
    return envelopes, rows


def test_golden_journal(spark, tmp_path):
    first = {"kind": 0, "v": {"sessionId": "s", "requests": []}}
    broken = request(1, requestId=None)
    root = journal(
        tmp_path, first, {"kind": 2, "k": ["requests"], "v": [request(0), broken]},
        {"kind": 1, "k": ["requests", 0, "copilotCredits"], "v": 7.25}, {"kind": 7}, "[1, 2",
        {"kind": 2, "k": ["requests"], "v": [{"requestId": "unfinished"}]},
        {"kind": 1, "k": ["requests", 3], "v": request(3)}, ending="\r\n",
    )
    envelopes, rows = tables(spark, root)
    stats = J.journal_stats(envelopes).first()
    assert (stats["total_lines"], stats["malformed_lines"], stats["unrecognised_envelopes"]) == (7, 1, 1)
    good = {r["request_id"]: r for r in N.good(rows).collect()}
    assert set(good) == {"q0", "q3"} and good["q3"]["turn_index"] == 3
    assert good["q0"]["credits"] == 7.25 and good["q3"]["credits"] is None
    assert good["q0"]["source_file"] == "ws1/chatSessions/a.jsonl"
    assert good["q0"]["source_offset"] == len(json.dumps(first)) + 2 + len(json.dumps({"kind": 2, "k": ["requests"], "v": [request(0), broken]})) + 2
    drift = N.quarantine(rows).collect()
    assert [(r["turn_index"], r["drift"]) for r in drift] == [(1, "requestId")]
    child = {k: [r.asDict() for r in v.where("request_id = 'q0'").collect()] for k, v in N.child_tables(N.good(rows), SALT).items()}
    assert [c["tokens"] for c in child["cost_centre"]] == [432]
    assert child["round"][0]["thinking_tokens"] == 27
    assert (child["tool_call"][0]["result_chars"], child["tool_call"][0]["target_start_line"]) == (5, 1)
    assert [(e["edit_count"], e["done"]) for e in child["edit"]] == [(2, True)]
    assert child["compaction"][0]["context_length_before"] == 77_000
    assert len(child["content_reference"]) == 1


def test_a_snapshot_starts_over_and_deep_paths_are_created(spark, tmp_path):
    root = journal(
        tmp_path, {"kind": 0, "v": {"sessionId": "old", "requests": [request(9)]}},
        {"kind": 0, "v": {"sessionId": "new", "requests": [{"requestId": "n"}]}},
        {"kind": 1, "k": ["requests", 0, "a", 1, "b"], "v": 3}, {"kind": 2, "k": ["requests", 0, "list"], "v": [1]},
        {"kind": 2, "k": ["requests", 0, "list"], "v": [2]},
    )
    envelopes, _ = tables(spark, root)
    docs = J.replay_journal(envelopes).collect()
    assert [json.loads(d["request_json"]) for d in docs] == [{"requestId": "n", "a": [None, {"b": 3}], "list": [1, 2]}]
    assert J.session_ids(envelopes).first()["raw_session_id"] == "new"


def test_ingest_reads_a_grown_journal_again(spark, tmp_path):
    snapshot = {"kind": 0, "v": {"sessionId": "s", "requests": [request(0)]}}
    root, store = journal(tmp_path, snapshot), str(tmp_path / "store")
    other = {"kind": 0, "v": {"sessionId": "t", "requests": [request(7)]}}
    journal(tmp_path, other, name="b.jsonl")
    first = ingest_journals(spark, ["/nowhere", root], store, SALT).first()
    assert (first["files_ingested"], first["files_skipped"], first["requests"]) == (2, 0, 2)
    # The same file grows: a patch, a new request, a broken line; a third file holds no session.
    patch = {"kind": 1, "k": ["requests", 0, "copilotCredits"], "v": 4.0}
    journal(tmp_path, snapshot, patch, {"kind": 2, "k": ["requests"], "v": [request(1), request(2, requestId=None)]}, "{oops")
    journal(tmp_path, '{"kind": 9}', name="c.jsonl")
    second = ingest_journals(spark, [root], store, SALT).first()
    assert (second["files_considered"], second["files_ingested"], second["files_skipped"]) == (3, 2, 1)
    assert (second["requests"], second["quarantined"], second["malformed_lines"], second["unrecognised_envelopes"]) == (2, 2, 1, 1)
    third = ingest_journals(spark, [root], store, SALT).first()
    assert (third["files_ingested"], third["files_skipped"], third["requests"]) == (0, 3, 0)
    rows = {r["request_id"]: (r["credits"], r["version"]) for r in read_current(spark, store, "request").collect()}
    assert rows == {"q0": (4.0, 1), "q1": (None, 1), "q7": (None, 0)}
    assert read_current(spark, store, "edit").agg(F.sum("edit_count")).first()[0] == 6
    drift = {(r["source_file"], r["turn_index"], r["drift"]) for r in read_batches(spark, store, "quarantine").collect()}
    assert drift == {("ws1/chatSessions/a.jsonl", 2, "requestId"), ("ws1/chatSessions/c.jsonl", None, N.FILE_DRIFT)}


def test_lines_of_a_file_in_many_ranges(spark, tmp_path):
    """Cut every 50 bytes, a file gives the lines and offsets that it gives whole."""
    rng = random.Random(8)
    lines = [rng.choice(["", "\r", "é" * rng.randint(1, 90), "x" * rng.randint(1, 200) + "\r", "a\rb", "\r\r"]) for _ in range(300)]
    contents = {"plain [1].txt": "\n".join(lines), "ended.txt": "\n".join(lines) + "\n", "cr.txt": "a\nb\r", "empty.txt": "", "one.txt": "\n\n\n"}
    for name, text in contents.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\xfe\nlast")
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbfone\ntwo\n")
    given = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cut = J.read_lines(spark, [str(p) for p in tmp_path.iterdir()])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        got = {(unquote(r["uri"].rsplit("/", 1)[1]), r["offset"], r["line"]) for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", given)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.format("binaryFile").load(str(tmp_path))
    want = {(r["path"].rsplit("/", 1)[1], r["offset"], r["line"]) for r in J.split_lines(whole).collect()}
    assert got == {(p, o, line.removeprefix("\ufeff")) for p, o, line in want}


def test_empty_and_idle_batches_are_committed(spark, tmp_path):
    """A service that starts before the first journal goes on, and runs without changes keep their summaries."""
    (tmp_path / "workspaceStorage").mkdir()
    root, store = str(tmp_path / "workspaceStorage"), str(tmp_path / "store")
    for _ in range(2):
        assert ingest_journals(spark, [root], store, SALT).first()["files_considered"] == 0
    snapshot = {"kind": 0, "v": {"sessionId": "s", "requests": [request(0)]}}
    journal(tmp_path, snapshot)
    assert ingest_journals(spark, [root], store, SALT).first()["requests"] == 1
    assert ingest_journals(spark, [root], store, SALT).first()["files_ingested"] == 0
    # The content changes under the same time and size: only a verifying run sees it.
    file = tmp_path / "workspaceStorage" / "ws1" / "chatSessions" / "a.jsonl"
    stat = file.stat()
    file.write_text(file.read_text().replace('"promptTokens": 8640', '"promptTokens": 9640'))
    os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert ingest_journals(spark, [root], store, SALT).first()["files_ingested"] == 0
    assert ingest_journals(spark, [root], store, SALT, verify=True).first()["files_ingested"] == 1
    assert read_current(spark, store, "request").first()["prompt_tokens"] == 9_640
    summaries = read_batches(spark, store, "summary").orderBy("batch").collect()
    assert [(r["batch"], r["files_ingested"]) for r in summaries] == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 1)]


def test_an_uncommitted_batch_is_not_seen(spark, tmp_path):
    root, store = journal(tmp_path, {"kind": 0, "v": {"sessionId": "s", "requests": [request(0)]}}), str(tmp_path / "store")
    ingest_journals(spark, [root], store, SALT)
    rows = read_current(spark, store, "request")
    rows.withColumns({"credits": F.lit(9.0), "version": F.lit(1).cast("long")}).write.parquet(f"{store}/request/batch=1")
    assert read_current(spark, store, "request").first()["credits"] is None


def test_unchanged_files_are_skipped(spark, tmp_path):
    root = journal(tmp_path, {"kind": 0, "v": {"sessionId": "s", "requests": []}})
    files = J.scan_journals(spark, [root])
    empty = spark.createDataFrame([], "file_path string, mtime_ms long, size_bytes long, content_hash string")
    fresh = J.incremental_files(files, empty)
    assert fresh.count() == 1
    assert J.incremental_files(files, J.ingested_state(fresh, 1)).count() == 0


@pytest.mark.parametrize("tree,chars", [('"bare"', 4), ('{"$mid": "no", "a": [["xy"], 3, true, null]}', 2), ("not json", 8)])
def test_measured_characters(spark, tree, chars):
    df = spark.createDataFrame([(tree,)], "t string")
    assert df.select(N.measure_result_chars(F.col("t"))).first()[0] == chars


def test_appended_requests_are_their_own_documents(spark, tmp_path):
    """Odd values of appends keep their type, an element that is null or a bare string is an unfinished request, and nothing is broadcast."""
    odd = {"requestId": "é[\"x\"]", "big": 12345678901234567890123, "n": None, "f": 1.50, "t": "[1]"}
    root = journal(
        tmp_path, {"kind": 0, "v": {"sessionId": "s", "requests": []}}, {"kind": 2, "k": ["requests"], "v": [odd, None]},
        {"kind": 2, "k": ["requests"], "v": []}, {"kind": 2, "k": ["requests"], "v": "[1]"}, {"kind": 2, "k": ["requests"], "v": ["bare"]},
        {"kind": 2, "k": ["requests"], "v": [{"requestId": "last"}]},
        {"kind": 1, "k": ["requests", 1, "requestId"], "v": "late"},
    )
    envelopes, rows = tables(spark, root)
    stats = J.journal_stats(envelopes).first()
    assert (stats["total_lines"], stats["malformed_lines"], stats["unrecognised_envelopes"]) == (7, 0, 1)
    replayed = J.replay_journal(envelopes)
    docs = {r["turn_index"]: r["request_json"] for r in replayed.collect()}
    assert json.loads(docs[0]) == odd and json.loads(docs[3]) == {"requestId": "last"} and json.loads(docs[1]) == {"requestId": "late"}
    assert set(docs) == {0, 1, 2, 3} and rows.count() == 0
    # No join rests on a guessed size.
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_appends_are_read_in_one_pass(spark, tmp_path):
    """A plain append gives its items without being parsed again; one that Spark would copy otherwise takes the careful way."""
    line = '{"kind":2,"k":["requests"],"v":[%s]}'
    plain, spaced, shortened, broken = line % '{"requestId":"é","a":[1,{"b":null}]},{"c":2.5}', line % '{"requestId": "s"}', line % '{"f":1.50}', (line % '{"x":1}')[:-3]
    df = spark.createDataFrame([("p", i, text) for i, text in enumerate([plain, spaced, shortened, broken, line % "null", line % ""])], "path string, offset long, line string")
    got = J.parse_envelopes(df).orderBy("offset").collect()
    assert got[0]["items"] == ['{"requestId":"é","a":[1,{"b":null}]}', '{"c":2.5}'] and got[0]["v"] is None
    assert [r["n_items"] for r in got] == [2, 1, 1, None, 1, 0] and [r["problem"] for r in got] == [None, None, None, "malformed", None, None]
    assert [(r["kind"], r["field"], r["depth"]) for r in got if r["kind"] is not None] == [(2, "requests", 1)] * 5
    assert [json.loads(r["items"][0]) for r in got[1:3]] == [{"requestId": "s"}, {"f": 1.5}] and got[4]["items"] == [None]


def test_session_ids_come_with_the_places_of_requests(spark, tmp_path):
    """Requests replayed with their files' session ids equal those joined later, and their text is joined no more."""
    journal(
        tmp_path, {"kind": 0, "v": {"sessionId": "s", "requests": []}}, {"kind": 2, "k": ["requests"], "v": [request(0), request(1)]},
        {"kind": 1, "k": ["requests", 0, "copilotCredits"], "v": 7.25}, {"kind": 1, "k": ["sessionId"], "v": "later"},
    )
    root = journal(tmp_path, {"kind": 2, "k": ["requests"], "v": [request(2)]}, {"kind": 1, "k": ["requests", 0, "modelId"], "v": "x"}, name="b.jsonl")
    envelopes, rows = tables(spark, root)
    sessions = J.session_ids(envelopes)
    direct = N.normalise_requests(J.replay_journal(envelopes, sessions), sessions, SALT)
    got, want = (sorted(map(str, x.select(rows.columns).collect())) for x in (direct, rows))
    assert got == want and len(got) == 3
    assert [r["drift"] for r in direct.where("request_id = 'q2'").collect()] == [N.FILE_DRIFT]
    assert "Join" not in direct._jdf.queryExecution().executedPlan().toString()


def test_lines_of_many_files_are_handed_over_together(monkeypatch):
    files = {f"f{i}": [b"", b"a\n\nb\r\n", b"c\r", "é\nx".encode()][i % 4] for i in range(300)}
    batch = pa.RecordBatch.from_arrays([pa.array(files), pa.array(files.values(), pa.binary())], ["path", "content"])
    kinds = [[], [(0, "a"), (3, "b")], [(0, "c\r")], [(0, "é"), (3, "x")]]
    want = [(f"f{i}", *line) for i in range(300) for line in kinds[i % 4]]
    told = lambda found: [tuple(r.values()) for b in found for r in b.to_pylist()]
    whole = list(J._split(iter([batch, batch])))
    assert len(whole) == 1 and told(whole) == want + want
    monkeypatch.setattr(J, "SPLIT_LINES", 7)
    few = list(J._split(iter([batch])))
    assert told(few) == want and max(b.num_rows for b in few) == 7
    monkeypatch.setattr(J, "SPLIT_BYTES", 2)
    small = list(J._split(iter([batch])))
    assert told(small) == want and max(b.num_rows for b in small) == 2
    assert sum(b.num_rows for b in J._split(iter([]))) == 0
