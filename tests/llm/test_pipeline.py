"""The pipeline's stages over the small tables, and odd documents."""

import corpus_pipeline as pipeline
from tallyspark.llm.common import written

SF = "/root/testdata/sf0.01"


def test_every_stage_works_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF))
        assert after.columns == docs.columns, name
        assert 0 < after.count() < before or name == "minhash_near_dedup", name
        docs, before = after, after.count()
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_odd_and_empty_tables(spark, odd):
    for df in (odd, odd.where("false")):
        docs = df
        for _, stage in pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF))
            assert docs.columns == odd.columns
        assert (pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (df is odd)


def test_all_eleven_queries_are_registered():
    from __spark_entry__ import queries

    names = queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
