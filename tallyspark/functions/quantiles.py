"""Exact order statistics by counting, then looking inside ever narrower ranges.

Values are first reduced to distinct value counts, then to a histogram of logarithmic buckets, which says
where the wanted position lies. That bucket is divided evenly between its least and greatest value, the part
that holds the position is divided again, and only the distinct values of the last part are sorted. A
logarithmic bucket spans a factor of 2^(1/32), in which there are 2^47 doubles at most; two divisions by
`PARTS` leave 2^19 of them, however the values are spread. Repeated values are a count and need no room.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import value_bucket

Rank = Callable[[Column], Column]

PARTS = 1 << 14


def q_floor(q: float) -> Rank:
    """Zero-based index floor(n * q)."""
    return lambda n: F.floor(n * F.lit(q)) + F.lit(1)


def q_ceil(q: float) -> Rank:
    """Zero-based index ceil(q * n) - 1, clamped."""
    return lambda n: F.least(n, F.greatest(F.lit(1), F.ceil(n * F.lit(q))))


def med_upper(n: Column) -> Column:
    """Upper of the two middles."""
    return F.floor(n / F.lit(2)) + F.lit(1)


def rank_pick(
    df: DataFrame,
    value: str,
    ranks: dict[str, Rank],
    by: Sequence[str] = (),
    count_as: str | None = None,
) -> DataFrame:
    """The value at each 1-based rank, one row per tenant.

    With no tenant key an empty input gives one row of nulls.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    v = F.col("_v").cast("double")
    histogram = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_hc"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumn("_before", F.sum("_hc").over(upto) - F.col("_hc")).withColumn(
        "_n", F.sum("_hc").over(Window.partitionBy(*by))
    )
    wanted = placed.withColumn(
        "_want",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank"))
                    for name, rank in ranks.items()
                ]
            )
        ),
    ).where(
        (F.col("_want.rank") > F.col("_before"))
        & (F.col("_want.rank") <= F.col("_before") + F.col("_hc"))
    )
    wanted = wanted.select(
        *by, "_b", "_before", "_n", "_low", "_high", F.col("_want.name").alias("_name"), F.col("_want.rank").alias("_rank")
    )
    for _ in range(2):
        wanted = _narrower(counts, wanted, by)
    inside = _inside(counts, wanted, by)
    within = (
        Window.partitionBy(*by, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(within)).where(
        (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
    )
    picked = [
        F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks
    ]
    if count_as:
        picked.append(F.coalesce(F.max("_n"), F.lit(0)).alias(count_as))
    return hits.groupBy(*by).agg(*picked) if by else hits.agg(*picked)


def _inside(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The distinct values in the range of each wanted rank."""
    return counts.join(wanted, [*by, "_b"]).where(F.col("_v").cast("double").between(F.col("_low"), F.col("_high")))


def _narrower(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """`wanted` with the one part, of `PARTS` even ones, that holds the rank; what lies below it goes to `_before`.

    `wanted`: a row for each (tenant, `_name`) with its bucket `_b`, `_rank`, `_before`, `_n` and the least and greatest value
    of its range, `_low` and `_high`. Parts grow with the value, so a part's least and greatest value say what is in it.
    """
    keys = [*by, "_b", "_name"]
    v = F.col("_v").cast("double")
    # Halves are subtracted, as the difference of two doubles may be too large for one.
    share = (v / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    part = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(PARTS - 1), F.floor(share * PARTS))).otherwise(F.lit(0))
    parts = _inside(counts, wanted, by).groupBy(*keys, part.cast("long").alias("_p")).agg(
        F.sum("_c").alias("_pc"), F.min(v).alias("_low"), F.max(v).alias("_high"),
        *[F.first(c).alias(c) for c in ("_before", "_rank", "_n")],
    )
    upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_before", F.col("_before") + F.sum("_pc").over(upto) - F.col("_pc"))
    held = placed.where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_pc")))
    return held.drop("_p", "_pc")


def interpolated(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear interpolation on position (n - 1) * q."""
    ranks: dict[str, Rank] = {}
    for name, q in quantiles.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q)) + F.lit(1)
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q)) + F.lit(1)
    picks = rank_pick(df, value, ranks, by, count_as="_n")
    out = []
    for name, q in quantiles.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        position = (F.col("_n") - 1) * F.lit(q)
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picks.select(*by, *out)


def med_mid(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the two middles."""
    return interpolated(df, value, {name: 0.5}, by)
