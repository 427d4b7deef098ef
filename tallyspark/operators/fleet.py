"""Fleet roll-ups of install bundles, drift against a fit, and spend anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers, value_bucket
from ..functions.quantiles import interpolated, med_mid
from ..session import attach
from .duplication import MIN_GROUP_SIZE
from .privacy import k_anonymise

# Top-level fields of a bundle, each declared in its manifest.
BUNDLE_FIELDS = (
    "install_id", "team", "period_from", "period_to", "developers", "total_credits",
    "measured_credits", "modelled_credits", "request_count", "by_model", "by_cost_centre",
    "by_waste_class", "tool_surface", "daily",
)
BUNDLE_VERSION = 1
MAD_SCALE = 0.6745
ALERT_THRESHOLD = 3.5
MIN_DAYS = 14
REFIT_DAYS, UNSEEN_SHARE, SURFACE_CHANGE, VOLUME_CHANGE = 90, 0.2, 0.25, 0.5


def build_bundle(
    totals: DataFrame,
    by_model: DataFrame,
    by_cost_centre: DataFrame,
    by_waste_class: DataFrame,
    tool_surface: DataFrame,
    daily: DataFrame,
    install: str = "install_id",
) -> DataFrame:
    """One nested row per install from tables that are already aggregated per install.

    `totals` also carries team, developers, period_from and period_to.
    """

    def nested(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy(install).agg(
            F.sort_array(F.collect_list(F.struct(*columns))).alias(name)
        )

    parts = (
        nested(by_model, "by_model", "model", "credits", "requests"),
        nested(by_cost_centre, "by_cost_centre", "label", "credits"),
        nested(by_waste_class, "by_waste_class", "class", "credits", "confidence"),
        nested(tool_surface, "tool_surface", "server", "tool_count", "invocations"),
        nested(daily, "daily", "day", "credits", "requests"),
    )
    out = totals.withColumn("bundle_version", F.lit(BUNDLE_VERSION))
    for part in parts:
        out = out.join(part, install, "left")
    return out.withColumn("manifest", F.array(*[F.lit(f) for f in BUNDLE_FIELDS]))


def fleet_rollup(bundles: DataFrame) -> DataFrame:
    """Fleet totals; only a fleet of five installs retires the single-install estimate."""
    total = F.sum("total_credits")
    return bundles.agg(
        F.count(F.lit(1)).alias("installs"),
        F.sum("developers").alias("developers"),
        total.alias("total_credits"),
        F.when(total > 0, F.sum("measured_credits") / total).otherwise(0.0).alias("measured_share"),
        F.sum("request_count").alias("request_count"),
        F.min(F.nullif("period_from", F.lit(""))).alias("period_from"),
        F.max(F.nullif("period_to", F.lit(""))).alias("period_to"),
    ).withColumn("extrapolation_retired", F.col("installs") >= MIN_GROUP_SIZE)


def rollup_teams(bundles: DataFrame) -> DataFrame:
    """Per team; the name is withheld under five developers, the money is not."""
    teams = bundles.groupBy("team").agg(
        F.sum("developers").alias("developers"),
        F.count(F.lit(1)).alias("installs"),
        F.sum("total_credits").alias("credits"),
        F.sum("request_count").alias("requests"),
    )
    each = F.when(F.col("developers") > 0, F.col("credits") / F.col("developers")).otherwise(0.0)
    return k_anonymise(teams.withColumn("credits_per_developer", each), "team", F.col("developers"))


def _exploded(bundles: DataFrame, column: str) -> DataFrame:
    return bundles.select("install_id", F.explode(column).alias("_x")).select("install_id", "_x.*")


def _with_share(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    total = bundles.agg(F.sum("total_credits").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("credits") / F.col("_total")).otherwise(0.0)
    return attach(rows, total).withColumn("share", share).drop("_total")


def rollup_models(bundles: DataFrame) -> DataFrame:
    rows = _exploded(bundles, "by_model").groupBy("model").agg(
        F.sum("credits").alias("credits"), F.sum("requests").alias("requests")
    )
    return _with_share(rows, bundles).orderBy(F.col("credits").desc(), "model")


def rollup_waste(bundles: DataFrame) -> DataFrame:
    rows = _exploded(bundles, "by_waste_class").groupBy("class").agg(
        F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("installs_affected")
    )
    return _with_share(rows, bundles).orderBy(F.col("credits").desc(), "class")


def rollup_tool_surface(bundles: DataFrame) -> DataFrame:
    """Largest tool count any install sees per server, with summed invocations."""
    return (
        _exploded(bundles, "tool_surface")
        .groupBy("server")
        .agg(
            F.count(F.lit(1)).alias("installs"),
            F.max("tool_count").alias("tool_count"),
            F.sum("invocations").alias("invocations"),
        )
        .withColumn("invocations_per_install", F.col("invocations") / F.col("installs"))
        .orderBy(F.col("invocations").desc(), "server")
    )


def spend_distribution(bundles: DataFrame) -> DataFrame:
    """Credits per developer over installs; concentration withheld below five installs."""
    per = bundles.select(
        "install_id",
        F.when(F.col("developers") > 0, F.col("total_credits") / F.col("developers"))
        .otherwise(F.col("total_credits"))
        .alias("x"),
    )
    whole = per.agg(
        F.count(F.lit(1)).alias("installs"), F.avg("x").alias("mean"), F.sum("x").alias("_sum")
    )
    marks = interpolated(per, "x", {"median": 0.5, "p10": 0.1, "p90": 0.9, "p99": 0.99})
    ranked = attach(
        row_numbers(per, [], value_bucket(F.col("x")), [F.col("x"), F.col("install_id")], "i"), whole
    )
    top = F.greatest(F.lit(1), F.ceil(F.col("installs") * 0.1))
    spread = ranked.agg(
        F.sum(F.col("i") * F.col("x")).alias("_weighted"),
        F.sum(F.when(F.col("i") > F.col("installs") - top, F.col("x"))).alias("_top"),
    )
    rows = attach(attach(whole, marks), spread)
    n = F.col("installs")
    gini = F.when(F.col("_sum") == 0, 0.0).otherwise(
        2 * F.col("_weighted") / (n * F.col("_sum")) - (n + 1) / n
    )
    enough = n >= MIN_GROUP_SIZE
    share = F.when(F.col("_sum") > 0, F.col("_top") / F.col("_sum")).otherwise(0.0)
    return rows.select(
        "installs", "mean", "median", "p10", "p90", "p99",
        F.when(enough, gini).alias("gini"),
        F.when(enough, share).alias("top_decile_share"),
        enough.alias("estimable"),
    )


def fit_snapshot(bundles: DataFrame) -> DataFrame:
    """What the fleet looked like when a policy was fitted, as (kind, subject, value) rows."""
    models = _exploded(bundles, "by_model").groupBy("model").agg(F.sum("credits").alias("value"))
    servers = _exploded(bundles, "tool_surface").groupBy("server").agg(
        F.max("tool_count").cast("double").alias("value")
    )
    total = bundles.agg(F.sum("total_credits").alias("value"))
    surface = servers.agg(F.sum("value").alias("value"))
    row = lambda df, kind, subject: df.select(
        F.lit(kind).alias("kind"), subject.alias("subject"), F.col("value").cast("double").alias("value")
    )
    return (
        row(models, "model", F.col("model"))
        .unionByName(row(servers, "server", F.col("server")))
        .unionByName(row(surface, "tool-surface", F.lit("tool surface")))
        .unionByName(row(total, "volume", F.lit("credit volume")))
    )


def detect_drift(fitted: DataFrame, current: DataFrame) -> DataFrame:
    """Findings between two snapshots: new and retired models, new servers, large moves."""
    both = fitted.withColumnRenamed("value", "was").join(
        current.withColumnRenamed("value", "now"), ["kind", "subject"], "full_outer"
    )
    total = current.where(F.col("kind") == "volume").agg(F.max("value").alias("_total"))
    rows = attach(both, total)
    growth = F.when(F.col("was") > 0, (F.col("now") - F.col("was")) / F.col("was")).otherwise(0.0)
    kind, was, now = F.col("kind"), F.col("was"), F.col("now")
    found = (
        F.when((kind == "model") & was.isNull(), "new-model")
        .when((kind == "model") & now.isNull(), "retired-model")
        .when((kind == "server") & was.isNull(), "new-server")
        .when((kind == "tool-surface") & (F.abs(growth) >= SURFACE_CHANGE), "tool-surface")
        .when((kind == "volume") & (F.abs(growth) >= VOLUME_CHANGE), "volume")
    )
    share = F.when(F.col("_total") > 0, now / F.col("_total")).otherwise(0.0)
    magnitude = (
        F.when(F.col("finding") == "new-model", share)
        .when(F.col("finding") == "retired-model", 0.0)
        .when(F.col("finding") == "new-server", now)
        .otherwise(growth)
    )
    return (
        rows.withColumn("finding", found)
        .where(F.col("finding").isNotNull())
        .select("finding", "subject", magnitude.alias("magnitude"))
    )


def drift_summary(
    findings: DataFrame, routed: Sequence[str], fitted_on: Column, today: Column
) -> DataFrame:
    """Whether to refit: age, credit share on unseen models, or a changed tool surface."""
    new = F.col("finding") == "new-model"
    unseen = new & ~F.col("subject").isin(*routed) if routed else new
    days = F.greatest(F.lit(0), F.datediff(today, fitted_on))
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        F.coalesce(F.sum(F.when(unseen, F.col("magnitude"))), F.lit(0.0)).alias("unseen_share"),
        F.coalesce(F.bool_or(F.col("finding").isin("new-server", "tool-surface")), F.lit(False)).alias("_surface"),
    ).select(
        "findings",
        days.alias("days_since_fit"),
        "unseen_share",
        ((days >= REFIT_DAYS) | (F.col("unseen_share") >= UNSEEN_SHARE) | F.col("_surface")).alias(
            "refit_recommended"
        ),
    )


def spend_anomalies(
    series: DataFrame, threshold: float = ALERT_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Days whose robust z reaches the threshold; none under 14 days or without spread."""
    by = list(by)
    middle = med_mid(series, "credits", "expected", by)
    counted = series.groupBy(*by).agg(F.count(F.lit(1)).alias("_days"))
    rows = attach(attach(series, middle, by), counted, by).withColumn(
        "_off", F.abs(F.col("credits") - F.col("expected"))
    )
    spread = med_mid(rows, "_off", "_mad", by)
    z = F.lit(MAD_SCALE) * (F.col("credits") - F.col("expected")) / F.col("_mad")
    rows = attach(rows, spread, by).where((F.col("_days") >= MIN_DAYS) & (F.col("_mad") > 0))
    return (
        rows.withColumn("robust_z", z)
        .where(F.abs("robust_z") >= threshold)
        .select(
            *by,
            "day",
            "credits",
            "expected",
            "robust_z",
            F.when(F.abs("robust_z") >= 2 * threshold, "critical").otherwise("warning").alias("severity"),
        )
        .orderBy(*by, F.abs("robust_z").desc(), "day")
    )


def executive_report(bundles: DataFrame) -> DataFrame:
    """One row: totals, per-developer spend, top five models and waste classes, caveats."""
    five = lambda rows, key: rows.limit(5).agg(
        F.sort_array(F.collect_list(F.struct(F.col("credits"), F.col(key))), asc=False).alias(f"top_{key}")
    )
    out = fleet_rollup(bundles)
    hidden = rollup_teams(bundles).agg(F.count(F.when(F.col("suppressed"), 1)).alias("suppressed_teams"))
    for part in (
        five(rollup_models(bundles), "model"),
        five(rollup_waste(bundles), "class"),
        spend_distribution(bundles).select("gini"),
        hidden,
    ):
        out = attach(out, part)
    return out.withColumn(
        "credits_per_developer",
        F.when(F.col("developers") > 0, F.col("total_credits") / F.col("developers")).otherwise(0.0),
    ).withColumn(
        "caveats",
        F.array_compact(
            F.array(
                F.lit("estimated-share"),
                F.when(~F.col("extrapolation_retired"), "too-few-installs"),
                F.when(F.col("gini") > 0.5, "concentrated-spend"),
                F.when(F.col("suppressed_teams") > 0, "withheld-teams"),
            )
        ),
    )
