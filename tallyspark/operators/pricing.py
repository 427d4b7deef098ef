"""Rate card and request pricing. Measured credits are never mixed into modelled ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TOKENS_PER_RATE_UNIT, canonicalise_model_id
from ..session import attach, join_dimension

RELEASE_STAMP = r"-(\d{6,8}|\d{4}-\d{2}-\d{2})$"


def derive_rate_card(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Credits per thousand prompt tokens of every model seen.

    A model with measured requests gets its own ratio; any other model gets the ratio
    over all measured requests of the tenant, marked as modelled.
    """
    by = list(by)
    usable = F.col("credits").isNotNull() & (F.col("prompt_tokens") > 0)
    per_model = requests.groupBy(*by, "model").agg(
        F.sum(F.when(usable, F.col("credits"))).alias("_credits"),
        F.sum(F.when(usable, F.col("prompt_tokens") / TOKENS_PER_RATE_UNIT)).alias("_k_tokens"),
        F.count(F.when(usable, 1)).alias("sample_size"),
        F.min("ts").alias("first_ts"),
    )
    blend = per_model.groupBy(*by).agg(
        F.coalesce(F.sum("_credits") / F.sum("_k_tokens"), F.lit(0.0)).alias("_blended")
    )
    return attach(per_model, blend, by).select(
        *by,
        "model",
        F.when(F.col("sample_size") > 0, F.col("_credits") / F.col("_k_tokens"))
        .otherwise(F.col("_blended"))
        .alias("rate"),
        "sample_size",
        F.when(F.col("sample_size") > 0, "measured").otherwise("modelled").alias("provenance"),
        "first_ts",
    )


def find_rates(models: DataFrame, card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rate of each wanted model: exact id, else canonical id, else one dated release.

    `models` holds distinct (by, model). A model whose dated releases are ambiguous, or
    that matches nothing, keeps nulls.
    """
    by = list(by)
    wanted = models.withColumn("_canon", canonicalise_model_id(F.col("model")))
    entries = card.select(
        *by,
        F.col("model").alias("card_model"),
        canonicalise_model_id(F.col("model")).alias("_canon"),
        F.struct("rate", "sample_size", "provenance", F.col("model").alias("rate_model")).alias("_e"),
        "first_ts",
    )
    exact = entries.select(*by, F.col("card_model").alias("model"), F.col("_e").alias("_exact"))
    first = F.struct(F.col("first_ts"), F.col("card_model"))
    canonical = entries.groupBy(*by, "_canon").agg(F.min_by("_e", first).alias("_canonical"))
    dated = (
        entries.where(F.col("_canon").rlike(RELEASE_STAMP))
        .withColumn("_canon", F.regexp_replace("_canon", RELEASE_STAMP, ""))
        .groupBy(*by, "_canon")
        .agg(F.first("_e").alias("_dated"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
    found = (
        wanted.join(exact, [*by, "model"], "left")
        .join(canonical, [*by, "_canon"], "left")
        .join(dated, [*by, "_canon"], "left")
        .withColumn("_rate", F.coalesce("_exact", "_canonical", "_dated"))
    )
    return found.select(*models.columns, "_rate.*")


def price_requests(requests: DataFrame, card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add `price` and `is_measured` to every request.

    `card` must be a materialised card of the whole corpus, also when `requests` is a
    filtered slice of it.
    """
    by = list(by)
    rates = card.select(*by, "model", F.col("rate").alias("_rate"))
    priced = join_dimension(requests, rates, [*by, "model"])
    modelled = F.col("prompt_tokens") / TOKENS_PER_RATE_UNIT * F.coalesce("_rate", F.lit(0.0))
    return priced.select(
        *requests.columns,
        F.coalesce(F.col("credits"), modelled).alias("price"),
        F.col("credits").isNotNull().alias("is_measured"),
    )


def spend(
    requests: DataFrame,
    card: DataFrame,
    keys: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Measured and modelled credits and counts per key.

    Unmeasured prompt tokens are added up per (key, model) before the rate is applied,
    so only one row per key and model meets the card, not one per request.
    """
    by = list(by)
    partial = requests.groupBy(*by, *[c.alias(k) for k, c in keys.items()], "model").agg(
        F.coalesce(F.sum("credits"), F.lit(0.0)).alias("measured_credits"),
        F.coalesce(
            F.sum(F.when(F.col("credits").isNull(), F.col("prompt_tokens"))), F.lit(0)
        ).alias("_unmeasured_tokens"),
        F.count(F.lit(1)).alias("request_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    rates = card.select(*by, "model", "rate")
    modelled = F.col("_unmeasured_tokens") / TOKENS_PER_RATE_UNIT * F.col("rate")
    return (
        partial.join(rates, [*by, "model"], "left")
        .groupBy(*by, *keys)
        .agg(
            F.sum("measured_credits").alias("measured_credits"),
            F.coalesce(F.sum(modelled), F.lit(0.0)).alias("modelled_credits"),
            F.sum("request_count").alias("request_count"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
        .withColumn("credits", F.col("measured_credits") + F.col("modelled_credits"))
    )


def cheapest_measured(card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cheapest measured model per tenant, with the dearest rate and how many are measured."""
    usable = card.where((F.col("provenance") == "measured") & (F.col("rate") > 0))
    return usable.groupBy(*by).agg(
        F.min_by("model", F.struct("rate", "first_ts", "model")).alias("cheapest_model"),
        F.min_by("sample_size", F.struct("rate", "first_ts", "model")).alias("cheapest_samples"),
        F.min("rate").alias("cheapest_rate"),
        F.max("rate").alias("dearest_rate"),
        F.count(F.lit(1)).alias("measured_models"),
    )
