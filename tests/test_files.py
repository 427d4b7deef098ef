"""Small file sources and sinks, and privacy refusals."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import privacy as PR
from tallyspark.sources import files as FI


def test_bundles_without_version_or_manifest_are_left_out(spark, tmp_path):
    good = {"bundleVersion": 1, "installId": "a", "team": "t", "manifest": [{"field": "team", "why": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({**good, "bundleVersion": 2, "installId": "b"}))
    (tmp_path / "c.json").write_text("{ not json")
    (tmp_path / "d.json").write_text(json.dumps({"bundleVersion": 1, "installId": "d"}))
    assert [r["install_id"] for r in FI.read_bundles(spark, str(tmp_path)).collect()] == ["a"]


def test_questions_and_spans_read_from_json(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"questionHash": "h", "askedBy": "d", "credits": 2, "ts": 5}]))
    assert tuple(FI.read_questions(spark, str(tmp_path / "q.json")).first()) == ("h", "d", 2.0, 5)
    span = {"name": "s", "startTimeUnixNano": "1999999", "attributes": [
        {"key": "gen_ai.prompt", "value": {"stringValue": "secret"}}, {"key": "gen_ai.request.model", "value": {"stringValue": "m"}},
        {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "7"}}]}
    payload = {"resourceSpans": [{"scopeSpans": [{"spans": [span, {"name": "no model"}]}]}]}
    (tmp_path / "o.json").write_text(json.dumps(payload))
    turns = FI.otel_turns(FI.otel_spans(FI.read_otel(spark, str(tmp_path / "o.json"))), "salt")
    row = turns.where("usable").first()
    assert (row["ts"], row["model"], row["prompt_tokens"], row["credits"]) == (1, "m", 7, None)
    assert tuple(FI.otel_counts(turns).first()) == (2, 1, 1)


def test_contributions_replace_only_their_month(spark, tmp_path):
    rows = lambda month, value: spark.createDataFrame([(month, value)], "period string, total long")
    out = str(tmp_path / "c")
    FI.write_contribution(rows("2024-01", 1), out)
    FI.write_contribution(rows("2024-02", 2), out)
    FI.write_contribution(rows("2024-01", 3), out)
    got = {(str(r["period"])[:7], r["total"]) for r in spark.read.option("partitionColumnTypeInference.enabled", "false").parquet(out).collect()}
    assert got == {("2024-01", 3), ("2024-02", 2)}
    FI.write_export({"totals": rows("2024-01", 3)}, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "totals")).first()["total"] == 3


def test_a_report_that_names_someone_is_refused(spark):
    safe = spark.createDataFrame([("src/a.py", 1)], "path string, n int")
    assert PR.assert_shareable(safe, 1) is safe
    with pytest.raises(PR.PrivacyError):
        PR.assert_shareable(safe.withColumn("path", F.lit("/home/me/a.py")), 1)
    with pytest.raises(PR.PrivacyError):
        PR.assert_shareable(safe, 3)
    assert PR.assert_shareable(safe.withColumn("session_id", F.lit("x")), 1, "self") is not None
