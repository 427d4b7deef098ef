"""Questions asked by several developers, and what a shared answer cache would save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach

MIN_GROUP_SIZE = 5
CACHE_THRESHOLD = 0.02


def _per_question(questions: DataFrame, by: list[str]) -> DataFrame:
    # Pre-grouping by asker keeps the distinct count of a hot question spread over tasks.
    per_asker = questions.groupBy(*by, "question_hash", "asked_by").agg(
        F.count(F.lit(1)).alias("n"), F.sum("credits").alias("c")
    )
    return per_asker.groupBy(*by, "question_hash").agg(
        F.count(F.lit(1)).alias("asked_by"),
        F.sum("n").alias("occurrences"),
        F.sum("c").alias("credits"),
    )


def detect_duplication(questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Questions with more than one asker.

    Clusters under five askers are flagged `suppressed` and lose their question hash;
    their money stays.
    """
    again = F.col("occurrences") - 1
    suppressed = F.col("asked_by") < MIN_GROUP_SIZE
    return (
        _per_question(questions, list(by))
        .where(F.col("asked_by") > 1)
        .select(
            *by,
            F.when(~suppressed, F.col("question_hash")).alias("question_hash"),
            "asked_by",
            "occurrences",
            "credits",
            (F.col("credits") * (again / F.col("occurrences"))).alias("redundant_credits"),
            suppressed.alias("suppressed"),
        )
    )


def duplication_summary(questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    repeat = F.col("asked_by") > 1
    redundant = F.col("credits") * ((F.col("occurrences") - 1) / F.col("occurrences"))
    per_question = _per_question(questions, by)
    found = per_question.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions_seen"),
        F.count(F.when(repeat & (F.col("asked_by") >= MIN_GROUP_SIZE), 1)).alias("clusters"),
        F.count(F.when(repeat & (F.col("asked_by") < MIN_GROUP_SIZE), 1)).alias(
            "suppressed_clusters"
        ),
        F.coalesce(F.sum(F.when(repeat, redundant)), F.lit(0.0)).alias("redundant_credits"),
        F.sum("credits").alias("total_credits"),
    )
    people = questions.groupBy(*by).agg(F.countDistinct("asked_by").alias("developers_seen"))
    share = F.when(
        F.col("total_credits") > 0, F.col("redundant_credits") / F.col("total_credits")
    ).otherwise(F.lit(0.0))
    # The total is not part of the report and would clash with the corpus totals.
    return attach(found, people, by).withColumn("redundant_share", share).drop("total_credits")


def assess_cache(
    questions: DataFrame, total_credits: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Whether caching the visible repeats clears two percent of `total_credits`."""
    by = list(by)
    visible = detect_duplication(questions, by).where(~F.col("suppressed"))
    saved = visible.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("redundant_credits").alias("credits_saved")
    )
    share = F.when(
        F.col("total_credits") > 0,
        F.coalesce("credits_saved", F.lit(0.0)) / F.col("total_credits"),
    ).otherwise(F.lit(0.0))
    return attach(total_credits, saved, by).select(
        *by,
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("credits_saved", F.lit(0.0)).alias("credits_saved"),
        share.alias("share"),
        (share >= CACHE_THRESHOLD).alias("worth_building"),
    )


def prefix_stability(prompts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the mean prompt already present at the smallest turn of its session."""
    per_session = prompts.groupBy(*by, "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("prompt_tokens").alias("smallest"),
        F.avg("prompt_tokens").alias("mean"),
    )
    return (
        per_session.where((F.col("n") >= 2) & (F.col("mean") > 0))
        .groupBy(*by)
        .agg(
            F.sum("n").alias("requests"),
            (F.sum(F.col("n") * F.col("smallest") / F.col("mean")) / F.sum("n")).alias(
                "cacheable_share"
            ),
        )
    )
