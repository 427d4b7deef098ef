"""Request complexity and its corpus-relative bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.quantiles import q_floor, rank_pick
from ..corpus import Corpus

LOW_SHARE, MEDIUM_SHARE = 0.33, 0.67


def complexity_scores(corpus: Corpus) -> DataFrame:
    """2 rounds + calls + 3 edits + thinking/500 + output/500 of every request.

    The three child tables are first reduced to one partial score per request and added
    up in one shuffle, instead of three joins.
    """
    keys = [*corpus.by, "request_id"]
    if corpus.shared:
        return corpus.facts.select(*keys, ((F.coalesce("points", F.lit(0)) + F.col("output_tokens")) / 500).alias("score"))
    # Everything is counted in 1/500 points, so that sums are exact integers.
    parts = (
        corpus.round.select(
            *keys, (F.lit(1000) + F.coalesce("thinking_tokens", F.lit(0))).cast("long").alias("part")
        )
        .unionByName(corpus.tool_call.select(*keys, F.lit(500).cast("long").alias("part")))
        .unionByName(corpus.edit.select(*keys, (F.col("edit_count") * 1500).alias("part")))
        .groupBy(*keys)
        .agg(F.sum("part").alias("part"))
    )
    return corpus.request.join(parts, keys, "left").select(
        *keys,
        ((F.coalesce("part", F.lit(0)) + F.col("output_tokens")) / 500).alias("score"),
    )


def complexity_bands(corpus: Corpus, scores: DataFrame | None = None) -> DataFrame:
    scores = complexity_scores(corpus) if scores is None else scores
    picks = {"low_ceiling": q_floor(LOW_SHARE), "medium_ceiling": q_floor(MEDIUM_SHARE)}
    bands = rank_pick(scores, "score", picks, corpus.by, count_as="sample_size")
    return bands.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("low_ceiling", "medium_ceiling")}
    )
