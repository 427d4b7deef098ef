"""Reports over a corpus whose sums are written once, and both ways of finding re-reads."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import simulate as X
from tallyspark.operators.corpus import Corpus
from tallyspark.operators.waste import complexity, rereads
from tallyspark.plans import reports
from tallyspark.schemas import TABLES
from tallyspark.testbed.q_simulate import POLICY


def corpus(spark, folder=None):
    rng = random.Random(5)
    ids = [f"r{i}" for i in range(60)]
    rows = {
        "request": [
            dict(request_id=r, session_id=f"s{i % 3}", ts=i // 2, model=rng.choice(["3-MEDIUM", "4-NOT SPECIFIED"]), prompt_tokens=900 + i,
                 output_tokens=i, credits=float(i), turn_index=i, source_file="w/chatSessions/a", source_offset=i)
            for i, r in enumerate(ids)
        ],
        "cost_centre": [
            dict(request_id=rng.choice([*ids, "orphan"]), category="prompt", label=rng.choice(["Tool Definitions", "Tool Results", "Files", None]),
                 percentage_of_prompt=1.0, tokens=rng.choice([None, 5, 80]))
            for _ in range(120)
        ],
        "tool_call": [
            dict(request_id=rng.choice(ids), round_id=f"c{i}", tool_call_id=f"c{i}", name="read_file", result_chars=rng.choice([None, 10, 9000]),
                 target_file_hash=rng.choice("ab"), target_start_line=rng.choice([None, 3, 40]), target_end_line=rng.choice([None, 20, 60]))
            for i in range(150)
        ],
        "round": [
            dict(request_id=rng.choice([*ids, "orphan"]), round_id=f"o{i}", ts=0, model_id=None, thinking_tokens=rng.choice([None, 70]), retries=0)
            for i in range(300)
        ],
        "edit": [dict(request_id=r, file_hash=rng.choice("ab"), edit_count=1, done=True) for r in ids[::7]],
    }
    made = {}
    for name in ("request", "cost_centre", "tool_call", "round", "edit", "compaction", "content_reference"):
        schema = TABLES[name]
        table = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows.get(name, ())], schema)
        if folder is not None:
            table.write.parquet(f"{folder}/{name}")
            table = spark.read.parquet(f"{folder}/{name}")
        made[name] = table
    return Corpus(**made)


def ordered(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_shared_sums_equal_the_separate_ones(spark):
    plain, shared = corpus(spark), corpus(spark)
    shared.shared = True
    for label in ("Tool Definitions", "Tool Results", "Files", "System Instructions"):
        assert ordered(shared.centre_tokens(label)) == ordered(plain.centre_tokens(label))
        assert ordered(shared.requests_with(label)) == ordered(plain.requests_with(label))
    assert ordered(shared.round_counts) == ordered(plain.round_counts)
    assert ordered(complexity.complexity_scores(shared)) == ordered(complexity.complexity_scores(plain))
    for lever in X.LEVERS:
        assert ordered(lever(shared, POLICY)) == ordered(lever(plain, POLICY))


def test_levers_read_cost_centres_and_rounds_once(spark, tmp_path):
    files = X.plan_changes(corpus(spark, tmp_path), POLICY).inputFiles()
    assert files and not any("/cost_centre/" in f or "/round/" in f for f in files)


def test_few_and_many_reads_give_the_same_rereads(spark, monkeypatch):
    found = []
    for few in (0, 20, 64, 10_000):
        monkeypatch.setattr(rereads, "FEW", few)
        found.append(ordered(rereads.scan_rereads(corpus(spark))))
    assert found[0] and all(f == found[0] for f in found)
    counted = rereads.scan_rereads(corpus(spark)).agg(F.count(F.when(~F.col("duplicate"), 1))).first()[0]
    assert counted  # some reads follow an edit


def test_a_failing_detector_is_no_finding(spark, monkeypatch):
    def broken(_):
        raise ValueError("no such column")

    monkeypatch.setitem(reports.DETECTORS, "W9", broken)
    for report in (reports.waste_findings, reports.waste_report):
        with pytest.raises(ValueError, match="no such column") as caught:
            report(corpus(spark))
        assert caught.value.__notes__ == ["waste detector W9"]
