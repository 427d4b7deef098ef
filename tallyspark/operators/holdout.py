"""Designing and reading a stratified holdout."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.ordered import row_numbers, value_bucket
from ..functions.scalars import round_half_up
from ..functions.stats import normal_quantile, two_sided_p
from ..session import attach, materialise
from .causal import BOOTSTRAP, SEED, average_effect, benjamini_hochberg, did_summary, event_study, group_time_effects, pre_trend

FRACTION = 0.15
MIN_STRATUM = 4
BALANCE_THRESHOLD = 0.1
ALPHA, POWER = 0.05, 0.8
CALIBRATION_TOLERANCE = 0.2
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Metric:
    id: str
    role: str
    lower_is_better: bool
    minimum_observations: int
    breach_threshold: float | None = None


# Secondary and guardrail metrics with their gates.
METRICS = (
    Metric("credits-per-developer-month", "secondary", True, 5),
    Metric("credits-per-durable-change", "secondary", True, 20),
    Metric("cost-centre-mix", "secondary", True, 50),
    Metric("pr-throughput", "guardrail", False, 20, 0.1),
    Metric("cycle-time", "guardrail", True, 20, 0.2),
    Metric("revert-rate-7d", "guardrail", True, 30, 0.5),
    Metric("model-override-rate", "guardrail", True, 50, 0.25),
)


def assign_holdout(
    units: DataFrame,
    seed: int,
    fraction: float = FRACTION,
    deciles: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """Stratum and arm of every unit.

    Strata are team by spend bucket when every cell can hold four units, else spend
    buckets alone, else teams, else one stratum. Quotas follow largest remainders, so the
    holdout has exactly round(n * fraction) units. Who is held out in a stratum follows a
    seeded digest order, which any executor, and SQL, can reproduce.
    """
    by = list(by)
    shape = units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("team").alias("_teams")
    )
    ranked = row_numbers(
        units, by, value_bucket(F.col("pre_spend")), [F.col("pre_spend"), F.col("unit")], "_rank"
    )
    rows = attach(ranked, shape, by)
    budget = F.floor(F.col("_n") / MIN_STRATUM)
    buckets = F.least(F.lit(deciles), budget)
    dimensions = (
        F.when(budget < 2, "none")
        .when(F.col("_teams") * deciles <= budget, "team+spend")
        .when(buckets >= 2, "spend")
        .otherwise("team")
    )
    rows = rows.withColumn("dimensions", dimensions).withColumn(
        "_buckets", F.when(F.col("dimensions") == "team+spend", deciles).otherwise(buckets)
    )
    bucket = F.least(
        F.col("_buckets") - 1, F.floor((F.col("_rank") - 1) * F.col("_buckets") / F.col("_n"))
    )
    team_part = F.when(F.col("dimensions").isin("team+spend", "team"), F.col("team")).otherwise("all")
    spend_part = F.when(
        F.col("dimensions").isin("team+spend", "spend"), bucket.cast("string")
    ).otherwise("0")
    rows = rows.withColumn("stratum", F.concat_ws("#", team_part, spend_part)).withColumn(
        "_draw", draw(seed, "unit")
    )
    strata = rows.groupBy(*by, "stratum").agg(F.count(F.lit(1)).alias("members"))
    exact = F.col("members") * F.lit(fraction)
    strata = strata.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    open_ = strata.where(F.col("members") > F.col("_floor")).withColumn(
        "_tie", draw(seed, "stratum")
    )
    # Remainders lie in [0, 1): a thousand chunks keep the ordering spread out.
    queue = row_numbers(
        open_, by, F.floor(-F.col("_rest") * 1000), [-F.col("_rest"), F.col("_tie"), F.col("stratum")],
        "_place",
    )
    spare = strata.groupBy(*by).agg(
        (round_half_up(F.sum("members") * F.lit(fraction)) - F.sum("_floor")).alias("_spare")
    )
    quotas = attach(
        strata.join(queue.select(*by, "stratum", "_place"), [*by, "stratum"], "left"), spare, by
    )
    quotas = quotas.select(
        *by,
        "stratum",
        (
            F.col("_floor") + F.coalesce((F.col("_place") <= F.col("_spare")).cast("long"), F.lit(0))
        ).alias("_quota"),
    )
    drawn = row_numbers(
        rows, [*by, "stratum"], F.shiftright(F.col("_draw"), 52), [F.col("_draw"), F.col("unit")], "_turn"
    )
    return drawn.join(quotas, [*by, "stratum"]).select(
        *by,
        "unit",
        "team",
        "pre_spend",
        "dimensions",
        "stratum",
        F.when(F.col("_turn") <= F.col("_quota"), "holdout").otherwise("treated").alias("arm"),
    )


def assess_balance(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    held, spend = F.col("arm") == "holdout", F.col("pre_spend")
    rows = assignments.groupBy(*by).agg(
        F.count(F.when(~held, 1)).alias("treated_units"),
        F.count(F.when(held, 1)).alias("holdout_units"),
        F.coalesce(F.avg(F.when(~held, spend)), F.lit(0.0)).alias("treated_mean"),
        F.coalesce(F.avg(F.when(held, spend)), F.lit(0.0)).alias("holdout_mean"),
        F.coalesce(F.var_samp(F.when(~held, spend)), F.lit(0.0)).alias("_vt"),
        F.coalesce(F.var_samp(F.when(held, spend)), F.lit(0.0)).alias("_vh"),
        F.sum(spend).alias("_total"),
        F.coalesce(F.sum(F.when(held, spend)), F.lit(0.0)).alias("_held"),
        F.max(spend).alias("_top"),
    )
    units = F.col("treated_units") + F.col("holdout_units")
    pooled = F.sqrt((F.col("_vt") + F.col("_vh")) / 2)
    share = lambda part: F.when(F.col("_total") > 0, part / F.col("_total")).otherwise(0.0)
    smd = F.when(pooled > 0, (F.col("treated_mean") - F.col("holdout_mean")) / pooled)
    return rows.select(
        *by,
        "treated_units",
        "holdout_units",
        "treated_mean",
        "holdout_mean",
        smd.alias("smd"),
        F.coalesce(F.abs(smd) <= BALANCE_THRESHOLD, F.lit(True)).alias("balanced"),
        share(F.col("_held")).alias("holdout_spend_share"),
        (F.col("holdout_units") / units).alias("holdout_headcount_share"),
        share(F.col("_top")).alias("top_unit_share"),
        (share(F.col("_top")) >= F.greatest(F.lit(0.25), 5 / units)).alias("concentrated"),
    )


def stratum_counts(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return assignments.groupBy(*by, "stratum").agg(
        F.count(F.when(F.col("arm") == "treated", 1)).alias("treated"),
        F.count(F.when(F.col("arm") == "holdout", 1)).alias("holdout"),
    )


def _z(alpha: float, power: float) -> float:
    return normal_quantile(1 - alpha / 2) + normal_quantile(power)


def assess_power(
    arms: DataFrame, alpha: float = ALPHA, power: float = POWER
) -> DataFrame:
    """Add the minimum detectable effect to rows of (sd, baseline, treated, holdout)."""
    possible = (F.col("treated") >= 1) & (F.col("holdout") >= 1) & (F.col("sd") > 0)
    mde = F.lit(_z(alpha, power)) * F.col("sd") * F.sqrt(1 / F.col("treated") + 1 / F.col("holdout"))
    mde = F.when(possible, mde)
    relative = F.when(F.col("baseline") != 0, F.abs(mde / F.col("baseline")))
    return arms.withColumn("mde", mde).withColumn("mde_relative", relative)


def required_units(effect: Column, sd: Column, alpha: float = ALPHA, power: float = POWER) -> Column:
    z = F.lit(_z(alpha, power))
    return F.when((effect > 0) & (sd > 0), F.ceil(2 * F.pow(z * sd, 2) / F.pow(effect, 2)))


def feasibility(powered: DataFrame, expected_effect: Column) -> DataFrame:
    """Whether the expected effect clears the minimum detectable one."""
    size = F.abs(expected_effect)
    return powered.withColumn("feasible", F.coalesce(size >= F.col("mde"), F.lit(False))).withColumn(
        "units_needed_per_arm",
        F.when(F.col("mde").isNotNull(), required_units(size, F.col("sd"))),
    )


def metric_definitions(spark, role: str | None = None) -> DataFrame:
    rows = [
        (m.id, m.role, m.lower_is_better, m.minimum_observations, m.breach_threshold)
        for m in METRICS
        if role is None or m.role == role
    ]
    schema = (
        "metric string, role string, lower_is_better boolean, minimum_observations long, "
        "breach_threshold double"
    )
    return spark.createDataFrame(rows, schema)


def _judged(observations: DataFrame, role: str | None, by: Sequence[str]) -> DataFrame:
    by = list(by)
    defined = F.broadcast(metric_definitions(observations.sparkSession, role))  # seven rows
    if by:
        tenants = observations.select(*by).distinct()
        listed = defined.agg(F.collect_list(F.struct("*")).alias("_d"))
        defined = attach(tenants, listed).select(*by, F.explode("_d").alias("_d")).select(*by, "_d.*")
    relative = (F.col("current") - F.col("baseline")) / F.abs("baseline")
    return defined.join(observations, [*by, "metric"], "left").withColumn(
        "relative", F.when(F.col("baseline") != 0, relative)
    )


def evaluate_guardrails(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Status of every guardrail: missing, underpowered, held or breached."""
    rows = _judged(observations, "guardrail", by)
    adverse = F.when(F.col("lower_is_better"), F.col("relative")).otherwise(-F.col("relative"))
    rows = rows.withColumn("adverse_movement", adverse)
    status = (
        F.when(F.col("observations").isNull(), "missing")
        .when(F.col("observations") < F.col("minimum_observations"), "underpowered")
        .when(F.col("adverse_movement") > F.col("breach_threshold"), "breached")
        .otherwise("held")
    )
    return rows.select(
        *by, "metric", "baseline", "current", "observations", "adverse_movement",
        F.col("breach_threshold").alias("threshold"), status.alias("status"),
    )


def secondary_tests(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided tests of all metrics, adjusted together."""
    rows = _judged(observations, None, by)
    tested = F.col("observations") >= F.col("minimum_observations")
    z = F.abs(F.coalesce("relative", F.lit(0.0))) * F.sqrt("observations")
    rows = rows.withColumn("p_value", F.when(tested, two_sided_p(z)))
    adjusted = benjamini_hochberg(rows, "p_value", "metric", by=by).select(
        *by, "metric", "q_value", "rejected"
    )
    return rows.join(adjusted, [*by, "metric"], "left").select(
        *by,
        "metric",
        "role",
        (F.col("current") - F.col("baseline")).alias("effect"),
        "p_value",
        "q_value",
        F.coalesce("rejected", F.lit(False)).alias("significant"),
    )


def p_from_interval(point: Column, low: Column, high: Column, alpha: float = 0.05) -> Column:
    half = (high - low) / 2
    error = half / F.lit(normal_quantile(1 - alpha / 2))
    return F.when(half > 0, two_sided_p(F.abs(point / error)))


def rollback_decision(guardrails: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Any breach reverts; the worst one is named."""
    breach = F.col("status") == "breached"
    rows = guardrails.groupBy(*by).agg(
        F.count(F.when(breach, 1)).alias("breaches"),
        F.max_by(
            F.when(breach, F.col("metric")), F.when(breach, F.struct("adverse_movement", "metric"))
        ).alias("worst"),
    )
    return rows.select(
        *by, F.when(F.col("breaches") > 0, "revert").otherwise("hold").alias("decision"), "breaches", "worst"
    )


def metric_observations(requests: DataFrame, deployed_ms: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean credits per request before and after deployment, unmeasured counted as zero.

    Filed under `credits-per-durable-change` for compatibility, although it is a figure
    per request.
    """
    after = F.col("ts") >= deployed_ms
    credits = F.coalesce("credits", F.lit(0.0))
    rows = requests.groupBy(*by).agg(
        F.avg(F.when(~after, credits)).alias("baseline"),
        F.avg(F.when(after, credits)).alias("current"),
        F.count(F.when(after, 1)).alias("observations"),
    )
    return rows.where(F.col("baseline").isNotNull() & F.col("current").isNotNull()).select(
        *by, F.lit("credits-per-durable-change").alias("metric"), "baseline", "current", "observations"
    )


def model_overrides(
    requests: DataFrame, default: str | None, sanctioned: Sequence[str], since_ms: int = 0, by: Sequence[str] = ()
) -> DataFrame:
    """Share of requests outside the sanctioned models; null when nothing is routed."""
    allowed = {*sanctioned, *([default] if default else [])}
    on = F.col("model").isin(*allowed) if allowed else F.lit(False)
    rows = requests.where(F.col("ts") >= since_ms).groupBy(*by).agg(
        F.count(F.lit(1)).alias("considered"), F.count(F.when(on, 1)).alias("_on")
    )
    if default is None:
        return rows.select(*by, "considered", F.lit(0).cast("long").alias("on_routed"),
                           F.lit(0).cast("long").alias("overrides"),
                           F.lit(None).cast("double").alias("override_rate"))
    overrides = F.col("considered") - F.col("_on")
    return rows.select(
        *by, "considered", F.col("_on").alias("on_routed"), overrides.alias("overrides"),
        F.when(F.col("considered") > 0, overrides / F.col("considered")).alias("override_rate"),
    )


def override_tally(requests: DataFrame, since_ms: int = 0, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    counts = requests.where(F.col("ts") >= since_ms).groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("requests")
    )
    whole = counts.groupBy(*by).agg(F.sum("requests").alias("_all"))
    return attach(counts, whole, by).select(
        *by, "model", "requests", (F.col("requests") / F.col("_all")).alias("share")
    )


def savings_pnl(months: DataFrame) -> DataFrame:
    """Realised saving per month against the simulated one; null without both arms."""
    usable = (F.col("treated_units") > 0) & (F.col("holdout_units") > 0)
    per_unit = F.col("holdout_mean") - F.col("treated_mean")
    realised = F.when(usable, per_unit * F.col("treated_units")).otherwise(F.lit(0.0))
    gap = realised - F.col("simulated_credits")
    return months.select(
        "*",
        realised.alias("realised_credits"),
        gap.alias("gap_credits"),
        F.when(usable & (F.col("simulated_credits") != 0), gap / F.col("simulated_credits")).alias(
            "gap_ratio"
        ),
        F.coalesce(usable, F.lit(False)).alias("estimable"),
    )


def pnl_calibration(pnl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    usable = pnl.where("estimable").groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"),
        F.coalesce(F.sum("simulated_credits"), F.lit(0.0)).alias("simulated_credits"),
        F.coalesce(F.sum("realised_credits"), F.lit(0.0)).alias("realised_credits"),
    )
    ratio = F.when(
        F.col("simulated_credits") != 0, F.col("realised_credits") / F.col("simulated_credits")
    )
    verdict = (
        F.when(ratio.isNull() | (F.col("months") == 0), "unknown")
        .when(ratio < 1 - CALIBRATION_TOLERANCE, "over-promised")
        .when(ratio > 1 + CALIBRATION_TOLERANCE, "under-promised")
        .otherwise("accurate")
    )
    return usable.withColumn("calibration", ratio).withColumn("verdict", verdict)


def guardrail_observations(
    commits: DataFrame,
    requests: DataFrame,
    deployed_ms: int,
    sanctioned: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """PR throughput, cycle time, 7-day revert rate and override rate before and after."""
    from .outcomes import HOUR_MS

    by = list(by)
    phase = F.when(F.col("ts") >= deployed_ms, "current").otherwise("baseline")
    phased = [*by, "phase"]
    work = commits.withColumn("phase", phase)
    span = work.groupBy(*phased).agg(
        F.countDistinct("author_id").alias("authors"),
        F.greatest(F.lit(1.0), (F.max("ts") - F.min("ts")) / (7 * DAY_MS)).alias("weeks"),
        F.count(F.when(F.col("is_merge") & F.col("pull_request").isNotNull(), 1)).alias("n"),
    )
    throughput = span.select(
        *phased, F.lit("pr-throughput").alias("metric"),
        (F.col("n") / F.col("authors") / F.col("weeks")).alias("value"), "n",
    )
    tips = work.where("is_merge").select(
        *phased, "sha", "ts", F.explode(F.expr("slice(parents, 2, greatest(size(parents), 1))")).alias("parent")
    )
    branch = commits.select(*by, F.col("sha").alias("parent"), F.col("ts").alias("parent_ts"))
    cycles = tips.join(branch, [*by, "parent"]).groupBy(*phased, "sha").agg(
        ((F.max("ts") - F.min("parent_ts")) / HOUR_MS).alias("hours")
    )
    cycle = cycles.where(F.col("hours") >= 0).groupBy(*phased).agg(
        F.avg("hours").alias("value"), F.count(F.lit(1)).alias("n")
    ).withColumn("metric", F.lit("cycle-time"))
    reverts = commits.where(F.col("reverts_sha").isNotNull()).groupBy(
        *by, F.col("reverts_sha").alias("sha")
    ).agg(F.min("ts").alias("reverted_ts"))
    landed = work.where(~F.col("is_merge")).join(reverts, [*by, "sha"], "left")
    soon = (F.col("reverted_ts") - F.col("ts")).between(0, 7 * DAY_MS)
    revert = landed.groupBy(*phased).agg(
        F.avg(F.coalesce(soon, F.lit(False)).cast("double")).alias("value"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("metric", F.lit("revert-rate-7d"))
    off = (~F.col("model").isin(*sanctioned)).cast("double")
    override = requests.withColumn("phase", phase).groupBy(*phased).agg(
        F.avg(off).alias("value"), F.count(F.lit(1)).alias("n")
    ).withColumn("metric", F.lit("model-override-rate"))
    facts = throughput.unionByName(cycle).unionByName(revert).unionByName(override)
    return facts.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("phase") == "baseline", F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("phase") == "current", F.col("value"))).alias("current"),
        F.coalesce(F.max(F.when(F.col("phase") == "current", F.col("n"))), F.lit(0)).alias("observations"),
    ).where(F.col("baseline").isNotNull() & F.col("current").isNotNull())


def holdout_verdict(
    average: DataFrame, trend: DataFrame, guardrails: DataFrame, registered: bool = True
) -> DataFrame:
    """One row: breach, estimate, pre-trend and significance, in that order of precedence."""
    breaches = guardrails.agg(F.count(F.when(F.col("status") == "breached", 1)).alias("breaches"))
    effect = average.agg(F.first("effect").alias("effect"), F.first("low").alias("low"), F.first("high").alias("high"))
    rows = attach(attach(breaches, effect), trend.select("passes"))
    verdict = (
        F.when(F.lit(not registered), "exploratory")
        .when(F.col("breaches") > 0, "guardrail-breach")
        .when(F.col("effect").isNull(), "no-estimate")
        .when(~F.col("passes"), "descriptive-only")
        .when((F.col("low") <= 0) & (F.col("high") >= 0), "no-detectable-effect")
        .otherwise("effect-detected")
    )
    p = p_from_interval(F.col("effect"), F.col("low"), F.col("high"))
    return rows.withColumn("p_value", p).withColumn("verdict", verdict)


# Metrics that no record can supply, and the primary one.
UNAVAILABLE = ("chat-abandonment", "developer-satisfaction")
PRIMARY = "effort-per-durable-change"


def intent_to_treat_panel(changes: DataFrame, period_days: int) -> DataFrame:
    """Mean surviving share of the fully observed changes of each author and period.

    Authors keep the arm they were drawn into, whatever they did later, so the panel knows no arms.
    """
    period = F.floor(F.col("ts") / (period_days * DAY_MS)).alias("period")
    observed = changes.where("fully_observed").groupBy(F.col("author_id").alias("unit"), period)
    return observed.agg(F.avg("surviving_fraction").alias("outcome"))


@dataclass(frozen=True)
class HoldoutAnalysis:
    """The parts of an analysis in reading order: what can void the effect comes before it."""

    registration: DataFrame
    balance: DataFrame
    power: DataFrame
    primary: DataFrame
    study: DataFrame
    trend: DataFrame
    summary: DataFrame
    secondary: DataFrame
    guardrails: DataFrame
    unavailable: DataFrame
    verdict: DataFrame

    def report(self) -> DataFrame:
        """All parts as rows (section, subject, figure, number, label)."""
        subjects = {"study": "relative_period", "secondary": "metric", "guardrails": "metric", "unavailable": "metric"}
        out = None
        for section in self.__dataclass_fields__:
            part = _figures(getattr(self, section), section, subjects.get(section))
            out = part if out is None else out.unionByName(part)
        return out


def _figures(df: DataFrame, section: str, subject: str | None) -> DataFrame:
    kinds = {c: k for c, k in df.dtypes if c != subject}
    cells = [
        F.struct(
            F.lit(c).alias("figure"),
            (F.lit(None) if k in ("string", "boolean") else F.col(c)).cast("double").alias("number"),
            (F.col(c) if k in ("string", "boolean") else F.lit(None)).cast("string").alias("label"),
        )
        for c, k in kinds.items()
    ]
    of = (F.col(subject) if subject else F.lit("")).cast("string").alias("subject")
    return df.select(F.lit(section).alias("section"), of, F.explode(F.array(*cells)).alias("_c")).select("section", "subject", "_c.*")


def analyse_holdout(
    assignments: DataFrame,
    changes: DataFrame,
    observations: DataFrame,
    deployed_ms: int | None,
    period_days: int = 7,
    registered: bool = True,
    alpha: float = ALPHA,
    power: float = POWER,
    draws: int = BOOTSTRAP,
    seed: int = SEED,
) -> HoldoutAnalysis:
    """From the drawn arms and the measured changes to the verdict.

    `assignments` is what `assign_holdout` drew, `changes` what `measure_durability` found, `observations` the levels
    of secondary and guardrail metrics. The treated arm is one cohort that starts in the period of `deployed_ms`, the
    holdout is never treated; authors without an arm count as never treated and in neither arm. Nothing is estimated,
    and the verdict says so, before deployment or where an arm has no observed change.
    """
    spark = assignments.sparkSession
    # Small beside the changes (one row per author and period) and read by every part below.
    panel = materialise(intent_to_treat_panel(changes, period_days))
    started = None if deployed_ms is None else deployed_ms // (period_days * DAY_MS)
    treated_at = F.when(F.col("arm") == "treated", F.lit(started)).cast("long").alias("treated_at")
    cohorts = assignments.select("unit", treated_at)
    seen = panel.select("unit").distinct().join(assignments.select("unit", "arm"), "unit")
    arms = seen.agg(
        F.count(F.when(F.col("arm") == "treated", 1)).alias("treated"), F.count(F.when(F.col("arm") == "holdout", 1)).alias("holdout")
    )
    spread = panel.agg(
        F.coalesce(F.stddev_samp("outcome"), F.lit(0.0)).alias("sd"), F.coalesce(F.avg("outcome"), F.lit(0.0)).alias("baseline")
    )
    powered = assess_power(attach(spread, arms), alpha, power)
    # What follows is a row per metric, period or resample, written once so that the parts do not plan it again.
    observations = materialise(observations)
    powered = materialise(powered)
    effects = materialise(group_time_effects(panel, cohorts, draws=draws, seed=seed))
    study = materialise(event_study(effects, alpha))
    trend = materialise(pre_trend(study))
    guardrails = materialise(evaluate_guardrails(observations))
    met = attach(powered.select("treated", "holdout"), average_effect(effects, alpha))
    both = (F.col("treated") > 0) & (F.col("holdout") > 0)
    average = materialise(met.where(both & F.col("effect").isNotNull()).select("effect", "low", "high"))
    verdict = materialise(holdout_verdict(average, trend, guardrails, registered))
    p = F.col("p_value")
    primary = verdict.select(
        F.lit(PRIMARY).alias("metric"), "effect", "low", "high", p, p.alias("q_value"),
        F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)).alias("significant"),
    )
    status = "registered" if registered else "unregistered"
    return HoldoutAnalysis(
        registration=spark.range(1).select(F.lit(status).alias("status")),
        balance=assess_balance(assignments),
        power=powered,
        primary=primary,
        study=study,
        trend=trend,
        summary=did_summary(effects, cohorts, panel),
        secondary=secondary_tests(observations),
        guardrails=guardrails,
        unavailable=spark.createDataFrame([(m, "no record") for m in UNAVAILABLE], "metric string, reason string"),
        verdict=verdict.select("breaches", "verdict"),
    )
