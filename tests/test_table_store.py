"""The table store: replacing per request, unseen batches, days and buckets opened."""

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.sources import tables as TS

DAY = 86_400_000


def requests(spark, rows):
    """(id, ts, prompt tokens) as requests."""
    df = spark.createDataFrame(rows, "request_id string, ts long, prompt_tokens long")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit("s" if f.name == "source_file" else None).cast(f.dataType).alias(f.name) for f in schemas.REQUEST])


def edits(spark, rows):
    return spark.createDataFrame([(r, h, 1, True) for r, h in rows], schemas.EDIT)


@pytest.fixture
def root(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = str(tmp_path / "store")
    rows = [(f"r{i}", i * DAY, i) for i in range(40)] + [("undated", None, 0)]
    TS.create({"request": requests(spark, rows), "edit": edits(spark, [(f"r{i}", h) for i in range(40) for h in "ab"])}, root, buckets=8)
    return root


def files_opened(df):
    """Files that the scans of a plan without exchanges opened when it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]


def test_a_request_is_replaced_with_its_children_and_may_move(spark, root):
    TS.replace({"request": requests(spark, [("r3", 30 * DAY, 99), ("new", 5, 1)]), "edit": edits(spark, [("r3", "c")])}, root)
    TS.replace({"request": requests(spark, [("r4", 4 * DAY, 77)]), "edit": edits(spark, [])}, root)
    now = {r["request_id"]: (r["ts"], r["prompt_tokens"]) for r in TS.scan(spark, root, "request").collect()}
    assert len(now) == 42 and now["r3"] == (30 * DAY, 99) and now["r4"][1] == 77 and now["r5"] == (5 * DAY, 5)
    kept = sorted((r["request_id"], r["file_hash"]) for r in TS.scan(spark, root, "edit").collect() if r["request_id"] in ("r3", "r4", "r5"))
    assert kept == [("r3", "c"), ("r5", "a"), ("r5", "b")]
    assert [r["prompt_tokens"] for r in TS.fetch(spark, root, "request", "r3").collect()] == [99]
    assert TS.fetch(spark, root, "request", "undated").count() == 1
    assert [r["file_hash"] for r in TS.fetch(spark, root, "edit", "r3").collect()] == ["c"]
    assert TS.fetch(spark, root, "edit", "r4").count() == 0 and TS.fetch(spark, root, "edit", "none").count() == 0
    assert TS.locate(spark, root, "r3").first()["ts"] == 30 * DAY and TS.locate(spark, root, "none").count() == 0
    moved = TS.scan(spark, root, "request", 3 * DAY, 4 * DAY + 1).collect()
    assert sorted(r["request_id"] for r in moved) == ["r4"]

    TS.compact(spark, root, ["request", "edit"], root + "-2")
    for name in ("request", "edit"):
        assert sorted(map(str, TS.scan(spark, root + "-2", name).collect())) == sorted(map(str, TS.scan(spark, root, name).collect()))
    assert spark.read.parquet(f"{root}-2/request").count() == 42


def test_a_batch_that_broke_off_is_not_seen(spark, root, monkeypatch):
    before = sorted(map(str, TS.scan(spark, root, "request").collect()))
    written = TS._append

    def break_off(rows, where, name, layout):
        if name == TS.LOOKUP:
            raise RuntimeError("lost")
        written(rows, where, name, layout)

    with monkeypatch.context() as m:
        m.setattr(TS, "_append", break_off)
        with pytest.raises(RuntimeError, match="lost"):
            TS.replace({"request": requests(spark, [("r1", 0, 5)])}, root)
    assert sorted(map(str, TS.scan(spark, root, "request").collect())) == before
    TS.replace({"request": requests(spark, [("r1", 0, 6)])}, root)
    assert [r["prompt_tokens"] for r in TS.fetch(spark, root, "request", "r1").collect()] == [6]
    assert TS.scan(spark, root, "edit").where("request_id = 'r1'").count() == 0


def test_a_look_up_opens_one_file_and_a_range_its_days(spark, root):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan's scans are then at hand
    try:
        looked_up(spark, root)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    with pytest.raises(ValueError, match="no days"):
        TS.scan(spark, root, "edit", 0)


def looked_up(spark, root):
    assert files_opened(TS._places(spark, root, "r7")) == [1]
    assert files_opened(TS.fetch(spark, root, "edit", "r7"))[0] == 1
    assert files_opened(TS.fetch(spark, root, "request", "r7"))[0] == 1
    with_days = spark.read.parquet(f"{root}/request").where((F.col(TS.SPAN) >= TS._span(F.lit(3 * DAY), 1)) & (F.col(TS.SPAN) <= TS._span(F.lit(5 * DAY), 1)))
    assert files_opened(with_days) == [3]


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path / "none")
    TS.create({"request": requests(spark, []), "edit": edits(spark, [])}, root)
    TS.replace({"request": requests(spark, [("a", 1, 2)]), "edit": edits(spark, [("a", "x")])}, root)
    assert TS.scan(spark, root, "request").count() == TS.scan(spark, root, "edit").count() == 1
