"""Spend roll-ups over priced requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TOKENS_PER_RATE_UNIT, day_key, month_key, workspace_id_of
from ..session import attach
from .pricing import spend

MONEY = ["credits", "measured_credits", "modelled_credits"]


def ledger_totals(requests: DataFrame, card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return spend(requests, card, {}, by).select(
        *by, *MONEY, "request_count", "prompt_tokens", "output_tokens"
    )


def spend_by_day(requests: DataFrame, card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        spend(requests, card, {"day": day_key(F.col("ts"))}, by)
        .select(*by, "day", *MONEY, "prompt_tokens", "output_tokens", "request_count")
        .orderBy(*by, "day")
    )


def spend_by_model(requests: DataFrame, card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`requests` may be a slice; the attached rate is the one of the whole corpus."""
    rates = card.select(
        *by, F.col("model").alias("_m"), "rate", "sample_size", "provenance"
    ).withColumnRenamed("_m", "model_id")
    per_model = spend(requests, card, {"model_id": F.col("model")}, by)
    return (
        per_model.join(rates, [*by, "model_id"], "left")
        .withColumnRenamed("model_id", "model")
        .select(*by, "model", *MONEY, "request_count", "rate", "sample_size", "provenance")
        .orderBy(*by, F.col("credits").desc(), "model")
    )


def spend_by_session(
    requests: DataFrame, card: DataFrame, by: Sequence[str] = (), top: int | None = None
) -> DataFrame:
    """Spend per session; `top` keeps the dearest sessions of each tenant, or overall without `by`."""
    out = (
        spend(requests, card, {"session_id": F.col("session_id")}, by)
        .select(*by, "session_id", *MONEY, "request_count", "first_ts", "last_ts")
        .orderBy(F.col("credits").desc(), *by, "session_id")
    )
    if top is None or not by:
        return out if top is None else out.limit(top)
    dearest = Window.partitionBy(*by).orderBy(F.col("credits").desc(), "session_id")
    return out.withColumn("_place", F.row_number().over(dearest)).where(F.col("_place") <= top).drop("_place")


def spend_by_cost_centre(
    cost_centres: DataFrame, requests: DataFrame, card: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Prompt-share apportioned spend per label.

    Centres of requests outside `requests` are dropped by the inner join. As with
    `spend`, unmeasured tokens are added per (label, model) before the rate applies.
    """
    by = list(by)
    share = F.col("percentage_of_prompt") / 100
    measured = F.col("credits").isNotNull()
    partial = (
        cost_centres.join(
            requests.select(*by, "request_id", "model", "credits", "prompt_tokens"),
            [*by, "request_id"],
        )
        .groupBy(*by, "label", "model")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.coalesce(F.sum(share * F.col("credits")), F.lit(0.0)).alias("measured_credits"),
            F.coalesce(
                F.sum(F.when(~measured, share * F.col("prompt_tokens"))), F.lit(0.0)
            ).alias("_unmeasured"),
            F.count(F.lit(1)).alias("request_count"),
        )
    )
    per_label = (
        partial.join(card.select(*by, "model", "rate"), [*by, "model"], "left")
        .groupBy(*by, "label")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum("measured_credits").alias("measured_credits"),
            F.coalesce(
                F.sum(F.col("_unmeasured") / TOKENS_PER_RATE_UNIT * F.col("rate")), F.lit(0.0)
            ).alias("modelled_credits"),
            F.sum("request_count").alias("request_count"),
        )
        .withColumn("credits", F.col("measured_credits") + F.col("modelled_credits"))
    )
    whole = per_label.groupBy(*by).agg(F.sum("tokens").alias("_all_tokens"))
    return (
        attach(per_label, whole, by)
        .withColumn("token_share", F.col("tokens") / F.col("_all_tokens"))
        .select(*by, "label", "tokens", "token_share", *MONEY, "request_count")
        .orderBy(*by, F.col("tokens").desc(), "label")
    )


def _zero_fill(values: DataFrame, by: list[str]) -> DataFrame:
    """One row per day of the axis and band; `values` has day, band and credits."""
    days = values.select(*by, "day").distinct()
    bands = values.groupBy(*by, "band").agg(F.sum("credits").alias("band_total"))
    # The axis is a list of calendar days, so it fits in one row per tenant.
    axis = days.groupBy(*by).agg(F.collect_set("day").alias("_days"))
    grid = attach(bands, axis, by).withColumn("day", F.explode("_days")).drop("_days")
    return grid.join(values, [*by, "day", "band"], "left").withColumn(
        "credits", F.coalesce("credits", F.lit(0.0))
    )


def spend_timeseries(
    requests: DataFrame,
    card: DataFrame,
    cost_centres: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Day by model, and day by cost-centre label, with every missing cell zero."""
    by = list(by)
    keys = {"day": day_key(F.col("ts")), "band": F.col("model")}
    per_model = spend(requests, card, keys, by).select(*by, "day", "band", "credits")
    out = _zero_fill(per_model, by).withColumn("dimension", F.lit("model"))
    if cost_centres is not None:
        share = F.col("percentage_of_prompt") / 100
        partial = (
            cost_centres.join(
                requests.select(*by, "request_id", "ts", "model", "credits", "prompt_tokens"),
                [*by, "request_id"],
            )
            .groupBy(*by, day_key(F.col("ts")).alias("day"), F.col("label").alias("band"), "model")
            .agg(
                F.coalesce(F.sum(share * F.col("credits")), F.lit(0.0)).alias("_measured"),
                F.coalesce(
                    F.sum(F.when(F.col("credits").isNull(), share * F.col("prompt_tokens"))),
                    F.lit(0.0),
                ).alias("_unmeasured"),
            )
        )
        per_label = (
            partial.join(card.select(*by, "model", "rate"), [*by, "model"], "left")
            .groupBy(*by, "day", "band")
            .agg(
                F.sum(
                    F.col("_measured")
                    + F.col("_unmeasured") / TOKENS_PER_RATE_UNIT * F.coalesce("rate", F.lit(0.0))
                ).alias("credits")
            )
        )
        out = out.unionByName(_zero_fill(per_label, by).withColumn("dimension", F.lit("cost_centre")))
    return out.select(*by, "dimension", "band", "band_total", "day", "credits").orderBy(
        *by, "dimension", F.col("band_total").desc(), "band", "day"
    )


def workspace_stats(requests: DataFrame, card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    keys = {"workspace_id": workspace_id_of(F.col("source_file")), "top_model": F.col("model")}
    per_model = spend(
        requests.where(workspace_id_of(F.col("source_file")).isNotNull()), card, keys, by
    )
    return (
        per_model.groupBy(*by, "workspace_id")
        .agg(
            F.sum("credits").alias("credits"),
            F.sum("measured_credits").alias("measured_credits"),
            F.sum("request_count").alias("request_count"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.max_by("top_model", F.struct("credits", "top_model")).alias("top_model"),
        )
        .orderBy(F.col("credits").desc(), *by, "workspace_id")
    )


def compare_windows(
    day_spend: DataFrame, start: Column, end: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Totals of a window against the equally long window right before it."""
    from ..functions.scalars import preceding_window

    before, until = preceding_window(start, end)
    now = F.col("day").between(start, end)
    prior = F.col("day").between(before, until)
    zero = F.lit(0.0)
    out = day_spend.where(now | prior).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(now, F.col("credits"))), zero).alias("current_credits"),
        F.coalesce(F.sum(F.when(prior, F.col("credits"))), zero).alias("previous_credits"),
        F.coalesce(F.sum(F.when(now, F.col("request_count"))), F.lit(0)).alias("current_requests"),
        F.coalesce(F.sum(F.when(prior, F.col("request_count"))), F.lit(0)).alias(
            "previous_requests"
        ),
    )
    delta = F.col("current_credits") - F.col("previous_credits")
    return out.select(
        "*",
        delta.alias("delta_credits"),
        F.when(F.col("previous_credits") != 0, delta / F.col("previous_credits") * 100).alias(
            "delta_percent"
        ),
    )


def day_drilldown(
    requests: DataFrame,
    card: DataFrame,
    cost_centres: DataFrame,
    day: str,
    by: Sequence[str] = (),
    top_sessions: int = 20,
) -> DataFrame:
    """One day's total, models, cost centres and dearest sessions in one long table."""
    by = list(by)
    start = F.unix_millis(F.lit(day).cast("timestamp"))
    one_day = requests.where((F.col("ts") >= start) & (F.col("ts") < start + 86_400_000))
    shape = lambda kind, key: [*by, F.lit(kind).alias("section"), key.alias("key"), "credits",
                               "request_count"]
    total = ledger_totals(one_day, card, by).select(*shape("total", F.lit("")))
    models = spend_by_model(one_day, card, by).select(*shape("model", F.col("model")))
    centres = spend_by_cost_centre(cost_centres, one_day, card, by).select(
        *shape("cost_centre", F.col("label"))
    )
    sessions = spend_by_session(one_day, card, by, top=top_sessions).select(
        *shape("session", F.col("session_id"))
    )
    return total.unionByName(models).unionByName(centres).unionByName(sessions)


def available_periods(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        requests.select(*by, month_key(day_key(F.col("ts"))).alias("month"))
        .distinct()
        .orderBy(*by, F.col("month").desc())
    )
