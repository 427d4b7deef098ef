"""Weighted Kaplan-Meier curves and the log-rank test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running
from ..functions.stats import chi_square_1_p
from ..session import attach

MINIMUM_AT_RISK = 10
MINIMUM_GROUP = 20


def kaplan_meier(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct duration: survival, standard error and the risk set.

    `at_risk` is counted before the duration and `remaining` after it. Observations with
    no weight or a negative duration are dropped. Rows are reduced to distinct durations
    before anything is ordered.
    """
    by = list(by)
    usable = observations.where(
        (F.col("duration") >= 0)
        & ~F.isnan("duration")
        & (F.col("duration") < float("inf"))
        & (F.col("weight") > 0)
    )
    per_time = usable.groupBy(*by, F.col("duration").alias("time")).agg(
        F.coalesce(F.sum(F.when(F.col("event"), F.col("weight"))), F.lit(0.0)).alias("events"),
        F.coalesce(F.sum(F.when(~F.col("event"), F.col("weight"))), F.lit(0.0)).alias("censored"),
    )
    subjects = per_time.groupBy(*by).agg(
        F.sum(F.col("events") + F.col("censored")).alias("subjects")
    )
    day = F.floor(F.col("time"))
    placed = running(
        per_time, by, day, [F.col("time")],
        {"_gone": ("sum", F.col("events") + F.col("censored"))},
    )
    placed = attach(placed, subjects, by).withColumn("remaining", F.col("subjects") - F.col("_gone"))
    placed = placed.withColumn(
        "at_risk", F.col("remaining") + F.col("events") + F.col("censored")
    ).drop("_gone")
    left = F.col("at_risk") - F.col("events")
    curve = running(
        placed, by, day, [F.col("time")],
        {
            "survival": ("product", F.lit(1.0) - F.col("events") / F.col("at_risk")),
            "_greenwood": (
                "sum",
                F.when(left > 0, F.col("events") / (F.col("at_risk") * left)).otherwise(F.lit(0.0)),
            ),
        },
    )
    return curve.select(
        *by,
        "time",
        "survival",
        (F.col("survival") * F.sqrt("_greenwood")).alias("standard_error"),
        "at_risk",
        "events",
        "censored",
        "remaining",
        "subjects",
    )


def survival_at(curve: DataFrame, time: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """Survival, risk set and estimability at a time; one row per tenant."""
    at = time if isinstance(time, Column) else F.lit(float(time))
    seen = F.col("time") <= at
    found = curve.groupBy(*by).agg(
        F.coalesce(
            F.max_by(F.when(seen, F.col("survival")), F.when(seen, F.col("time"))), F.lit(1.0)
        ).alias("survival"),
        F.coalesce(
            F.max_by(F.when(seen, F.col("remaining")), F.when(seen, F.col("time"))),
            F.max("subjects"),
            F.lit(0.0),
        ).alias("at_risk"),
    )
    return found.withColumn("estimable", F.col("at_risk") >= MINIMUM_AT_RISK)


def log_rank(
    observations: DataFrame, arm: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Compare the rows where `arm` is true with the rest."""
    by = list(by)
    weight = lambda side, event: F.coalesce(
        F.sum(F.when((F.col("_a") == side) & (F.col("event") == event), F.col("weight"))), F.lit(0.0)
    )
    per_time = (
        observations.withColumn("_a", arm)
        .groupBy(*by, F.col("duration").alias("time"))
        .agg(
            weight(True, True).alias("events_a"),
            weight(False, True).alias("events_b"),
            (weight(True, True) + weight(True, False)).alias("gone_a"),
            (weight(False, True) + weight(False, False)).alias("gone_b"),
        )
    )
    totals = per_time.groupBy(*by).agg(
        F.sum("gone_a").alias("total_a"), F.sum("gone_b").alias("total_b")
    )
    placed = running(
        per_time, by, F.floor(F.col("time")), [F.col("time")],
        {"_ga": ("sum", F.col("gone_a")), "_gb": ("sum", F.col("gone_b"))}, exclusive=True,
    )
    n_a, n_b = F.col("total_a") - F.col("_ga"), F.col("total_b") - F.col("_gb")
    n, d = n_a + n_b, F.col("events_a") + F.col("events_b")
    counted = (d > 0) & (n > 1)
    zero = F.lit(0.0)
    sums = attach(placed, totals, by).groupBy(*by).agg(
        F.max("total_a").alias("total_a"),
        F.max("total_b").alias("total_b"),
        F.coalesce(F.sum(F.when(counted, F.col("events_a"))), zero).alias("observed_a"),
        F.coalesce(F.sum(F.when(counted, d * n_a / n)), zero).alias("expected_a"),
        F.coalesce(
            F.sum(F.when(counted, d * n_a * n_b * (n - d) / (n * n * (n - 1)))), zero
        ).alias("_variance"),
    )
    comparable = (
        (F.col("total_a") >= MINIMUM_GROUP)
        & (F.col("total_b") >= MINIMUM_GROUP)
        & (F.col("_variance") > 0)
    )
    gap = F.col("observed_a") - F.col("expected_a")
    chi = F.when(comparable, gap * gap / F.col("_variance")).otherwise(zero)
    return sums.select(
        *by,
        chi.alias("chi_square"),
        F.when(comparable, chi_square_1_p(chi)).otherwise(F.lit(1.0)).alias("p_value"),
        "observed_a",
        "expected_a",
        comparable.alias("comparable"),
    )
