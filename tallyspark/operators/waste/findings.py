"""Shape of a finding and its evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scalars import sample_confidence, with_effect_size
from ...session import attach

EVIDENCE = "array<struct<kind:string,ref:string,count:bigint,amount:double,credits:double>>"


def item(
    kind: str,
    ref: Column | str,
    count: Column | None = None,
    amount: Column | None = None,
    credits: Column | None = None,
) -> Column:
    """One piece of evidence."""
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(ref) if isinstance(ref, str) else ref).cast("string").alias("ref"),
        (F.lit(None) if count is None else count).cast("long").alias("count"),
        (F.lit(None) if amount is None else amount).cast("double").alias("amount"),
        (F.lit(None) if credits is None else credits).cast("double").alias("credits"),
    )


def worst(
    rows: DataFrame, by: Sequence[str], evidence: Column, order: Sequence[Column], limit: int
) -> DataFrame:
    """The first `limit` rows per tenant as an evidence array.

    The ranking filter is cut inside each input partition before the shuffle.
    """
    ranked = rows.select(*by, evidence.alias("_item"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    window = Window.partitionBy(*by).orderBy(*[f"_o{i}" for i in range(len(order))])
    kept = ranked.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit)
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("_rank", "_item"))), lambda entry: entry["_item"]
    )
    return kept.groupBy(*by).agg(listed.alias("_worst"))


def finding(
    stats: DataFrame,
    by: Sequence[str],
    waste_class: str,
    tier: str,
    title: Column,
    credits: Column,
    confidence: Column,
    evidence: Column | Sequence[Column] = (),
    listed: DataFrame | None = None,
) -> DataFrame:
    """Turn one row of gated statistics per tenant into a finding."""
    heads = [evidence] if isinstance(evidence, Column) else list(evidence)
    head = F.array(*heads).cast(EVIDENCE) if heads else F.array().cast(EVIDENCE)
    if listed is not None:
        stats = attach(stats, listed, by)
        head = F.concat(head, F.coalesce(F.col("_worst"), F.array().cast(EVIDENCE)))
    return stats.select(
        *by,
        F.lit(waste_class).alias("class"),
        title.alias("title"),
        credits.cast("double").alias("credits"),
        confidence.alias("confidence"),
        F.lit(tier).alias("tier"),
        head.alias("evidence"),
    )


def confidence(n: Column, half: float, effect: Column) -> Column:
    return with_effect_size(sample_confidence(n, half), effect)


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100, 1).cast("string"), F.lit("%"))
