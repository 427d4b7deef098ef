"""Staggered difference-in-differences with a unit bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import coefficients, multiplicities, residues
from ..functions.ordered import running, value_bucket
from ..functions.quantiles import q_ceil, rank_pick
from ..session import attach, materialise

BOOTSTRAP = 1000
SEED = 20260731
MIN_UNITS = 3
FDR = 0.05


def _deltas(panel: DataFrame, cohorts: DataFrame, comparison: str) -> DataFrame:
    """(unit, g, t, role, delta): outcome change since the period before each cohort's start.

    Role 'size' rows carry the cohort of every unit once, to count units per cohort.
    """
    units = panel.select("unit").distinct().join(cohorts.select("unit", "treated_at"), "unit", "left")
    starts = units.agg(F.sort_array(F.collect_set("treated_at")).alias("starts"))
    rows = attach(panel.join(units, "unit"), starts).withColumn("g", F.explode("starts"))
    own = F.col("treated_at") == F.col("g")
    later = F.col("treated_at") > F.greatest("period", "g")
    control = F.col("treated_at").isNull()
    if comparison == "not-yet-treated":
        control = control | later
    rows = rows.where((F.col("period") != F.col("g") - 1) & (own | control))
    base = panel.select("unit", (F.col("period") + 1).alias("g"), F.col("outcome").alias("base"))
    moved = rows.join(base, ["unit", "g"]).select(
        "unit",
        "g",
        F.col("period").alias("t"),
        F.when(own, "treated").otherwise("control").alias("role"),
        (F.col("outcome") - F.col("base")).alias("delta"),
    )
    sizes = units.select(
        "unit", F.col("treated_at").alias("g"), F.lit(None).cast("long").alias("t"),
        F.lit("size").alias("role"), F.lit(1.0).alias("delta"),
    )
    return moved.unionByName(sizes)


def bootstrap_sums(deltas: DataFrame, draws: int = BOOTSTRAP, seed: int = SEED) -> DataFrame:
    """Weighted sums of deltas per resample and cell.

    Each task adds up its own rows for all resamples as one matrix product, so what is
    shuffled has one row per (task, resample, cell), whatever the number of units.
    """
    held = coefficients(seed, draws)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = batch[["g", "t", "role"]].drop_duplicates().reset_index(drop=True)
            codes = batch.merge(cells.reset_index(), on=["g", "t", "role"], how="left")["index"]
            sums = np.zeros((len(cells), draws + 1))
            weights = np.zeros((len(cells), draws + 1))
            for start in range(0, len(batch), 2000):
                part = slice(start, start + 2000)
                # A unit has a row for each cohort and period; its multiplicities are worked out once.
                pairs = batch[["h1", "h2"]].to_numpy()[part]
                units, of = np.unique(pairs, axis=0, return_inverse=True)
                multiplicity = multiplicities(units[:, 0], units[:, 1], held)[of]
                chosen = np.zeros((len(cells), len(multiplicity)))
                chosen[codes.to_numpy()[part], np.arange(len(multiplicity))] = 1.0
                weights += chosen @ multiplicity
                sums += chosen @ (multiplicity * batch["delta"].to_numpy()[part][:, None])
            out = cells.loc[cells.index.repeat(draws + 1)].reset_index(drop=True)
            out["b"] = np.tile(np.arange(draws + 1), len(cells))
            out["total"], out["weight"] = sums.ravel(), weights.ravel()
            yield out[["b", "g", "t", "role", "total", "weight"]]

    schema = "b long, g long, t long, role string, total double, weight double"
    return (
        deltas.select(F.col("g").cast("long"), F.col("t").cast("long"), "role", "delta", *residues(seed, "unit"))
        .mapInPandas(partial, schema)
        .groupBy("b", "g", "t", "role")
        .agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    )


def group_time_effects(
    panel: DataFrame,
    cohorts: DataFrame,
    comparison: str = "not-yet-treated",
    draws: int = BOOTSTRAP,
    seed: int = SEED,
    min_units: int = MIN_UNITS,
) -> DataFrame:
    """Effect per resample, cohort and period; draw 0 is the point estimate.

    Cells without enough units on both sides, or without any observed change on one of
    them, have a null effect. The table has one row per resample and cell.
    """
    deltas = _deltas(panel, cohorts, comparison)
    # Cells and resamples only: small, and read three times below.
    sums = materialise(bootstrap_sums(deltas, draws, seed))
    size = sums.where(F.col("role") == "size").select("b", F.col("g").alias("c"), F.col("weight").alias("n"))
    periods = panel.agg(F.sort_array(F.collect_set("period")).alias("periods"))
    per_draw = size.groupBy("b").agg(F.collect_list(F.struct("c", "n")).alias("sizes"))
    cells = (
        attach(size.where(F.col("c").isNotNull()), periods)
        .select("b", F.col("c").alias("g"), F.col("n").alias("treated_units"), F.explode("periods").alias("t"))
        .where((F.col("t") != F.col("g") - 1) & (F.col("treated_units") >= min_units))
        .join(per_draw, "b")
    )
    eligible = lambda s, cutoff: s["c"].isNull() | (
        (s["c"] > cutoff) if comparison == "not-yet-treated" else F.lit(False)
    )
    cells = cells.withColumn("_cutoff", F.greatest("t", "g")).withColumn(
        "control_units",
        F.aggregate(
            F.filter("sizes", lambda s: eligible(s, F.col("_cutoff"))), F.lit(0.0), lambda a, s: a + s["n"]
        ),
    )
    side = lambda role: sums.where((F.col("role") == role) & (F.col("weight") > 0)).select(
        "b", "g", "t", (F.col("total") / F.col("weight")).alias(role)
    )
    out = cells.join(side("treated"), ["b", "g", "t"], "left").join(
        side("control"), ["b", "g", "t"], "left"
    )
    return out.select(
        "b",
        "g",
        "t",
        (F.col("t") - F.col("g")).alias("relative_period"),
        "treated_units",
        "control_units",
        F.when(
            F.col("control_units") >= min_units, F.col("treated") - F.col("control")
        ).alias("effect"),
    )


def _weighted(effects: DataFrame, *keys: str) -> DataFrame:
    return effects.where(F.col("effect").isNotNull()).groupBy(*keys).agg(
        (F.sum(F.col("effect") * F.col("treated_units")) / F.sum("treated_units")).alias("effect"),
        F.max("treated_units").alias("units"),
    )


def _interval(draws: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    picks = {"low": q_ceil(alpha / 2), "high": q_ceil(1 - alpha / 2)}
    bounds = rank_pick(draws.where(F.col("b") > 0), "effect", picks, keys)
    point = draws.where(F.col("b") == 0).drop("b")
    joined = point.join(bounds, list(keys), "left") if keys else attach(point, bounds)
    return joined.withColumns({c: F.coalesce(c, "effect") for c in ("low", "high")})


def event_study(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Effect and interval per period relative to treatment."""
    out = _interval(_weighted(effects, "b", "relative_period"), ["relative_period"], alpha)
    return out.select("relative_period", "effect", "low", "high", F.col("units").cast("long").alias("units"))


def average_effect(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Average effect over treated periods; no row when nothing was estimable."""
    post = _weighted(effects.where(F.col("relative_period") >= 0), "b").drop("units")
    return _interval(post, [], alpha).select("effect", "low", "high")


def did_summary(effects: DataFrame, cohorts: DataFrame, panel: DataFrame) -> DataFrame:
    """Unit counts and the cells that had to be dropped."""
    units = panel.select("unit").distinct().join(cohorts, "unit", "left")
    counts = units.agg(
        F.count("treated_at").alias("treated_units"),
        F.count(F.when(F.col("treated_at").isNull(), 1)).alias("control_units"),
        F.countDistinct("treated_at").alias("cohorts"),
    )
    dropped = effects.where(F.col("b") == 0).agg(
        F.count(F.when(F.col("effect").isNull(), 1)).alias("dropped_cells")
    )
    return attach(counts, dropped)


def pre_trend(study: DataFrame) -> DataFrame:
    """Verdict over the periods before -1; untestable without any, and then not passing."""
    before = study.where(F.col("relative_period") < -1)
    violated = (F.col("low") > 0) | (F.col("high") < 0)
    worst = F.struct(-F.abs("effect"), "relative_period")
    out = before.agg(
        F.count(F.lit(1)).alias("periods_tested"),
        F.count(F.when(violated, 1)).alias("violations"),
        F.min_by("relative_period", worst).alias("worst_period"),
        F.min_by("effect", worst).alias("worst_effect"),
    )
    return out.select(
        ((F.col("periods_tested") > 0) & (F.col("violations") == 0)).alias("passes"),
        (F.col("periods_tested") == 0).alias("untestable"),
        "*",
    )


def two_way_fixed_effects(panel: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Coefficient of the double-demeaned regression of outcome on treatment."""
    treated = F.coalesce((F.col("period") >= F.col("treated_at")).cast("double"), F.lit(0.0))
    rows = panel.join(cohorts, "unit", "left").select("unit", "period", "outcome", treated.alias("d"))
    means = lambda name, *keys: rows.groupBy(*keys).agg(
        F.avg("outcome").alias(f"{name}_y"), F.avg("d").alias(f"{name}_d")
    )
    joined = attach(rows.join(means("u", "unit"), "unit").join(means("p", "period"), "period"), means("g"))
    y = F.col("outcome") - F.col("u_y") - F.col("p_y") + F.col("g_y")
    d = F.col("d") - F.col("u_d") - F.col("p_d") + F.col("g_d")
    sums = joined.agg(F.sum(y * d).alias("yd"), F.sum(d * d).alias("dd"))
    return sums.select(F.when(F.col("dd") > 0, F.col("yd") / F.col("dd")).alias("coefficient"))


def benjamini_hochberg(
    tests: DataFrame, p_value: str = "p_value", key: str = "key", fdr: float = FDR, by: Sequence[str] = ()
) -> DataFrame:
    """Add `q_value` and `rejected`; rows without a p-value are left out."""
    by = list(by)
    usable = tests.where(F.col(p_value).isNotNull() & ~F.isnan(p_value))
    counted = usable.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    order = [F.col(p_value), F.col(key)]
    chunk = value_bucket(F.col(p_value))
    placed = running(usable, by, chunk, order, {"_i": ("sum", F.lit(1).cast("long"))})
    placed = attach(placed, counted, by)
    stepped = running(
        placed, by, chunk, order,
        {"_q": ("min", F.col(p_value) * F.col("_m") / F.col("_i"))}, reverse=True,
    )
    return (
        stepped.withColumn("q_value", F.least(F.lit(1.0), F.col("_q")))
        .withColumn("rejected", F.col("q_value") <= fdr)
        .drop("_i", "_m", "_q")
    )
