"""Registered queries: causal estimates and holdout experiments."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.draws import PRIME, poisson_steps
from ..operators import causal as C
from ..operators import holdout as HO
from ..session import attach
from .q_outcomes import History, upto
from .registry import query, rounded

DEPLOYED = 883_612_800_000  # 1998-01-01


class Did:
    def __init__(self, t) -> None:
        self.t = t

    @cached_property
    def effects(self):
        return C.group_time_effects(self.t.panel, self.t.cohort)

    @cached_property
    def study(self):
        return C.event_study(self.effects)


DID = dict(
    pu="SELECT p.unit, p.period, p.outcome, c.treated_at FROM panel p LEFT JOIN cohort c USING (unit)",
    pairs="""SELECT u.g, a.period AS t, a.unit, a.treated_at, a.outcome - b.outcome AS delta FROM (SELECT DISTINCT treated_at AS g FROM pu WHERE treated_at IS NOT NULL) u
      JOIN pu a ON a.period <> u.g - 1 JOIN pu b ON b.unit = a.unit AND b.period = u.g - 1""",
    cells="""SELECT g, t, avg(delta) FILTER (treated_at = g) - avg(delta) FILTER (treated_at IS NULL OR treated_at > greatest(t, g)) AS effect,
      (SELECT count(DISTINCT unit) FROM pu WHERE pu.treated_at = g) AS n FROM pairs GROUP BY g, t""",
)


@query("j13_group_time_effects", "SELECT g, t, round(effect, 4) AS effect, n AS treated_units FROM cells", **DID)
def _(t):
    out = Did(t).effects.where(F.col("b") == 0)
    return rounded(out.select("g", "t", "effect", F.col("treated_units").cast("long").alias("treated_units")))


@query("o05_staggered_did", """
SELECT t - g AS relative_period, round(sum(effect * n) / sum(n), 4) AS effect, max(n) AS units FROM cells WHERE effect IS NOT NULL GROUP BY 1""", **DID)
def _(t):
    return rounded(Did(t).study.select("relative_period", "effect", "units"))


@query("o05_average_effect", "SELECT round(sum(effect * n) / sum(n), 4) AS effect FROM cells WHERE effect IS NOT NULL AND t >= g", **DID)
def _(t):
    return rounded(C.average_effect(Did(t).effects).select("effect"))


@query("o05_did_summary", """SELECT count(DISTINCT unit) FILTER (treated_at IS NOT NULL) AS treated_units, count(DISTINCT unit) FILTER (treated_at IS NULL) AS control_units,
  count(DISTINCT treated_at) AS cohorts, (SELECT count(*) FROM cells WHERE effect IS NULL) AS dropped_cells FROM pu""", **DID)
def _(t):
    return C.did_summary(Did(t).effects, t.cohort, t.panel)


def resampled(pu: str, seed: int = C.SEED, draws: int = C.BOOTSTRAP, least: int = C.MIN_UNITS) -> dict[str, str]:
    """CTEs of a bootstrapped estimate over `pu` (unit, period, outcome, treated_at): study, average, dropped cells."""
    p = PRIME
    counts = " + ".join(f"CAST(u >= {x} AS INTEGER)" for x in poisson_steps())
    parts = ", ".join(f"CAST('0x' || substr(s, {1 + 8 * i}, 8) AS BIGINT) % {p} AS c{i}" for i in range(6))
    interval = "list_sort(list(effect) FILTER (b > 0))"
    ends = ", ".join(
        f"coalesce(v[CAST(least(len(v), greatest(1, ceil(len(v) * {q}::DOUBLE))) AS BIGINT)], effect) AS {name}"
        for q, name in ((0.05 / 2, "low"), (1 - 0.05 / 2, "high"))
    )
    return dict(
        pu=pu,
        units="SELECT DISTINCT unit, treated_at FROM pu",
        moves="""SELECT u.g, a.period AS t, a.unit, a.treated_at, a.outcome - b.outcome AS delta FROM (SELECT DISTINCT treated_at AS g FROM pu WHERE treated_at IS NOT NULL) u
      JOIN pu a ON a.period <> u.g - 1 JOIN pu b ON b.unit = a.unit AND b.period = u.g - 1""",
        spots=f"""SELECT unit, CAST('0x' || substr(s, 1, 15) AS BIGINT) % {p} AS h1, CAST('0x' || substr(s, 16, 15) AS BIGINT) % {p} AS h2
      FROM (SELECT unit, sha256('{seed}:' || unit) AS s FROM units)""",
        ways=f"SELECT b, {parts} FROM (SELECT b, sha256('{seed}/' || b) AS s FROM range(1, {draws + 1}) r(b))",
        weights=f"""SELECT unit, b, {counts} AS w FROM (SELECT unit, b, (t * ((c3 * t + c4) % {p}) + c5) % {p} AS u
      FROM (SELECT *, (h1 * c0 + h2 * c1 + c2) % {p} AS t FROM spots, ways)) UNION ALL SELECT unit, 0, 1 FROM units""",
        sizes="SELECT b, treated_at AS c, sum(w) AS n FROM weights JOIN units USING (unit) GROUP BY ALL",
        sums="""SELECT b, g, t, sum(w * delta) FILTER (treated_at = g) / nullif(sum(w) FILTER (treated_at = g), 0) AS own,
      sum(w * delta) FILTER (treated_at IS NULL OR treated_at > greatest(t, g)) / nullif(sum(w) FILTER (treated_at IS NULL OR treated_at > greatest(t, g)), 0) AS other
      FROM moves JOIN weights USING (unit) GROUP BY b, g, t""",
        cells=f"""SELECT s.b, s.c AS g, p.t, s.n, (SELECT sum(o.n) FROM sizes o WHERE o.b = s.b AND (o.c IS NULL OR o.c > greatest(p.t, s.c))) AS controls
      FROM sizes s, (SELECT DISTINCT period AS t FROM pu) p WHERE s.c IS NOT NULL AND p.t <> s.c - 1 AND s.n >= {least}""",
        effects=f"SELECT b, g, t, t - g AS rel, n, CASE WHEN controls >= {least} THEN own - other END AS effect FROM cells LEFT JOIN sums USING (b, g, t)",
        study=f"""SELECT rel AS relative_period, effect, units, {ends} FROM (SELECT rel, max(effect) FILTER (b = 0) AS effect, max(units) FILTER (b = 0) AS units, {interval} AS v
      FROM (SELECT b, rel, sum(effect * n) / sum(n) AS effect, max(n) AS units FROM effects WHERE effect IS NOT NULL GROUP BY 1, 2) GROUP BY 1) WHERE effect IS NOT NULL""",
        average=f"""SELECT effect, {ends} FROM (SELECT max(effect) FILTER (b = 0) AS effect, {interval} AS v
      FROM (SELECT b, sum(effect * n) / sum(n) AS effect FROM effects WHERE effect IS NOT NULL AND rel >= 0 GROUP BY 1)) WHERE effect IS NOT NULL""",
        trend="""SELECT count(*) AS periods_tested, count(*) FILTER (low > 0 OR high < 0) AS violations,
      first(relative_period ORDER BY abs(effect) DESC, relative_period) AS worst_period, first(effect ORDER BY abs(effect) DESC, relative_period) AS worst_effect
      FROM study WHERE relative_period < -1""",
    )


BOOT = resampled(DID["pu"])


@query("o06_bootstrap_intervals", """SELECT relative_period, round(effect, 4) AS effect, round(low, 4) AS low, round(high, 4) AS high, CAST(units AS BIGINT) AS units FROM study""", **BOOT)
def _(t):
    return rounded(Did(t).study)


@query("o07_pre_trend", """SELECT periods_tested > 0 AND violations = 0 AS passes, periods_tested = 0 AS untestable, periods_tested, violations,
  worst_period, round(worst_effect, 4) AS worst_effect FROM trend""", **BOOT)
def _(t):
    return rounded(C.pre_trend(Did(t).study))


@query("o08_two_way_fixed_effects", """
SELECT round(sum(y * d) / sum(d * d), 4) AS coefficient FROM (
  SELECT outcome - avg(outcome) OVER (PARTITION BY unit) - avg(outcome) OVER (PARTITION BY period) + avg(outcome) OVER () AS y,
    z - avg(z) OVER (PARTITION BY unit) - avg(z) OVER (PARTITION BY period) + avg(z) OVER () AS d
  FROM (SELECT *, CASE WHEN period >= treated_at THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS z FROM pu))""", pu=DID["pu"])
def _(t):
    return rounded(C.two_way_fixed_effects(t.panel, t.cohort))


PVALUES = """SELECT CAST(p_partkey AS VARCHAR) AS key, (p_retailprice * 7 % 1000) / 1000.0 AS p FROM part"""


@query("v08_benjamini_hochberg", """
SELECT key, round(p, 6) AS p_value, round(least(1, min(p * m / i) OVER (ORDER BY p DESC, key DESC)), 6) AS q_value,
  least(1, min(p * m / i) OVER (ORDER BY p DESC, key DESC)) <= 0.05 AS rejected
FROM (SELECT *, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS m FROM tests)""", tests=PVALUES)
def _(t):
    tests = t.raw("part").select(
        F.col("p_partkey").cast("string").alias("key"), (F.col("p_retailprice") * 7 % 1000 / 1000.0).alias("p_value")
    )
    return rounded(C.benjamini_hochberg(tests), 6)


STRATA = """SELECT *, team || '#' || CAST(least(9, floor((row_number() OVER (ORDER BY pre_spend, unit) - 1) * 10 / count(*) OVER ())) AS BIGINT) AS stratum FROM roster"""


@query("e01_holdout_strata", "SELECT unit, stratum, 'team+spend' AS dimensions FROM strata", strata=STRATA)
def _(t):
    return HO.assign_holdout(t.roster, 7).select("unit", "stratum", "dimensions")


@query("e01_holdout_sizes", """SELECT (SELECT count(*) FROM roster) - CAST(floor(count(*) * 0.15::DOUBLE + 0.5) AS BIGINT) AS treated,
  CAST(floor(count(*) * 0.15::DOUBLE + 0.5) AS BIGINT) AS holdout, count(DISTINCT stratum) AS strata, true AS quotas_within_one FROM strata""", strata=STRATA)
def _(t):
    counts = HO.stratum_counts(HO.assign_holdout(t.roster, 7))
    exact = (F.col("treated") + F.col("holdout")) * 0.15
    return counts.agg(
        F.sum("treated").alias("treated"), F.sum("holdout").alias("holdout"), F.count(F.lit(1)).alias("strata"),
        F.bool_and(F.abs(F.col("holdout") - exact) < 1).alias("quotas_within_one"),
    )


def drawn(seed: int) -> dict[str, str]:
    """CTEs of the arms of the roster: quotas by largest remainders, members by the order of their digests."""
    number = lambda of: f"CAST('0x' || substr(sha256('{seed}:' || {of}), 1, 15) AS BIGINT)"
    return dict(
        strata=STRATA,
        share="SELECT stratum, floor(count(*) * 0.15::DOUBLE) AS whole, count(*) * 0.15::DOUBLE - floor(count(*) * 0.15::DOUBLE) AS rest FROM strata GROUP BY 1",
        quota=f"""SELECT stratum, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, {number("stratum")}, stratum)
      <= (SELECT floor(count(*) * 0.15::DOUBLE + 0.5) FROM strata) - (SELECT sum(whole) FROM share) THEN 1 ELSE 0 END AS quota FROM share""",
        assigned=f"""SELECT unit, team, pre_spend, stratum, CASE WHEN turn <= quota THEN 'holdout' ELSE 'treated' END AS arm
      FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {number("unit")}, unit) AS turn FROM strata) JOIN quota USING (stratum)""",
    )


@query("e01_assign_holdout", "SELECT unit, team, pre_spend, 'team+spend' AS dimensions, stratum, arm FROM assigned", **drawn(7))
def _(t):
    return HO.assign_holdout(t.roster, 7)


def fixed_arms(t):
    held = F.col("unit").cast("long") % 7 == 0
    return t.roster.withColumn("arm", F.when(held, "holdout").otherwise("treated")).withColumn("stratum", F.col("team"))


ARMS = "SELECT *, CASE WHEN CAST(unit AS BIGINT) % 7 = 0 THEN 'holdout' ELSE 'treated' END AS arm FROM roster"


@query("e02_assess_balance", """
SELECT t AS treated_units, h AS holdout_units, round(mt, 6) AS treated_mean, round(mh, 6) AS holdout_mean, round((mt - mh) / sqrt((vt + vh) / 2), 6) AS smd,
  abs((mt - mh) / sqrt((vt + vh) / 2)) <= 0.1 AS balanced, round(sh / s, 6) AS holdout_spend_share, round(h / (h + t), 6) AS holdout_headcount_share,
  round(top / s, 6) AS top_unit_share, top / s >= greatest(0.25, 5 / (h + t)) AS concentrated
FROM (SELECT count(*) FILTER (arm = 'treated') AS t, count(*) FILTER (arm = 'holdout') AS h, avg(pre_spend) FILTER (arm = 'treated') AS mt,
  avg(pre_spend) FILTER (arm = 'holdout') AS mh, var_samp(pre_spend) FILTER (arm = 'treated') AS vt, var_samp(pre_spend) FILTER (arm = 'holdout') AS vh,
  sum(pre_spend) AS s, sum(pre_spend) FILTER (arm = 'holdout') AS sh, max(pre_spend) AS top FROM arms)""", arms=ARMS)
def _(t):
    return rounded(HO.assess_balance(fixed_arms(t)), 6)


Z = 1.959963984540054 + 0.8416212335729143


@query("e03_power_feasibility", f"""
SELECT team, round(sd, 6) AS sd, round(mean, 6) AS baseline, t AS treated, h AS holdout, round({Z} * sd * sqrt(1 / t + 1 / h), 6) AS mde,
  round({Z} * sd * sqrt(1 / t + 1 / h) / mean, 6) AS mde_relative, 0.2 * mean >= {Z} * sd * sqrt(1 / t + 1 / h) AS feasible,
  CAST(ceil(2 * ({Z} * sd) ** 2 / (0.2 * mean) ** 2) AS BIGINT) AS units_needed_per_arm
FROM (SELECT team, stddev_samp(pre_spend) AS sd, avg(pre_spend) AS mean, count(*) FILTER (arm = 'treated') AS t, count(*) FILTER (arm = 'holdout') AS h FROM arms GROUP BY 1)""", arms=ARMS)
def _(t):
    arms = fixed_arms(t).groupBy("team").agg(
        F.stddev_samp("pre_spend").alias("sd"), F.avg("pre_spend").alias("baseline"),
        F.count(F.when(F.col("arm") == "treated", 1)).alias("treated"), F.count(F.when(F.col("arm") == "holdout", 1)).alias("holdout"),
    )
    return rounded(HO.feasibility(HO.assess_power(arms), F.col("baseline") * 0.2), 6)


SANCTIONED = ("4-NOT SPECIFIED", "3-MEDIUM")
OBS = dict(
    work=f"SELECT *, ts >= {DEPLOYED} AS after FROM commit_log",
    obs=f"""
  SELECT 'pr-throughput' AS metric, after, count(*) FILTER (is_merge AND pull_request IS NOT NULL) / count(DISTINCT author_id) / greatest(1, (max(ts) - min(ts)) / 604800000) AS value,
    count(*) FILTER (is_merge AND pull_request IS NOT NULL) AS n FROM work GROUP BY after
  UNION ALL SELECT 'cycle-time', after, avg(hours), count(*) FROM (SELECT m.after, (m.ts - min(p.ts)) / 3600000 AS hours FROM (SELECT *, unnest(parents[2:]) AS parent FROM work WHERE is_merge) m
    JOIN commit_log p ON p.sha = m.parent GROUP BY m.sha, m.after, m.ts) WHERE hours >= 0 GROUP BY after
  UNION ALL SELECT 'revert-rate-7d', after, avg(CASE WHEN r.ts - w.ts BETWEEN 0 AND 604800000 THEN 1.0::DOUBLE ELSE 0 END), count(*) FROM work w
    LEFT JOIN (SELECT reverts_sha AS sha, min(ts) AS ts FROM commit_log WHERE reverts_sha IS NOT NULL GROUP BY 1) r USING (sha) WHERE NOT is_merge GROUP BY after
  UNION ALL SELECT 'model-override-rate', ts >= {DEPLOYED}, avg(CASE WHEN model IN ('4-NOT SPECIFIED', '3-MEDIUM') THEN 0 ELSE 1.0::DOUBLE END), count(*) FROM request GROUP BY 2""",
    observed="""SELECT metric, max(value) FILTER (NOT after) AS baseline, max(value) FILTER (after) AS current, max(n) FILTER (after) AS observations FROM obs GROUP BY 1""",
)


def observed(t):
    return HO.guardrail_observations(t.commit, t.request, DEPLOYED, SANCTIONED)


@query("e09_guardrail_observations", "SELECT metric, round(baseline, 8) AS baseline, round(current, 8) AS current, observations FROM observed", **OBS)
def _(t):
    return rounded(observed(t), 8)


GUARD = """SELECT metric, baseline, current, observations, threshold, adverse,
  CASE WHEN observations < need THEN 'underpowered' WHEN adverse > threshold THEN 'breached' ELSE 'held' END AS status
  FROM (SELECT o.*, d.need, d.threshold, sign * (current - baseline) / abs(baseline) AS adverse FROM observed o
    JOIN (VALUES ('pr-throughput', -1, 20, 0.1::DOUBLE), ('cycle-time', 1, 20, 0.2), ('revert-rate-7d', 1, 30, 0.5), ('model-override-rate', 1, 50, 0.25)) d(metric, sign, need, threshold) USING (metric))"""


@query("e04_evaluate_guardrails", """SELECT metric, round(baseline, 6) AS baseline, round(current, 6) AS current, observations, round(adverse, 6) AS adverse_movement, threshold, status FROM guard""", **OBS, guard=GUARD)
def _(t):
    return rounded(HO.evaluate_guardrails(observed(t)), 6)


@query("e08_rollback_decision", """SELECT CASE WHEN count(*) FILTER (status = 'breached') > 0 THEN 'revert' ELSE 'hold' END AS decision,
  count(*) FILTER (status = 'breached') AS breaches, arg_max(metric, adverse) FILTER (status = 'breached') AS worst FROM guard""", **OBS, guard=GUARD)
def _(t):
    return HO.rollback_decision(HO.evaluate_guardrails(observed(t)))


@query("a36_metric_observations", f"""SELECT 'credits-per-durable-change' AS metric, round(avg(coalesce(credits, 0)) FILTER (ts < {DEPLOYED}), 6) AS baseline,
  round(avg(coalesce(credits, 0)) FILTER (ts >= {DEPLOYED}), 6) AS current, count(*) FILTER (ts >= {DEPLOYED}) AS observations FROM request""")
def _(t):
    return rounded(HO.metric_observations(t.request, DEPLOYED), 6)


TAIL = """0.3989422804014327 * exp(-z * z / 2) * (1 / (1 + 0.2316419 * z)) * (0.31938153 + (1 / (1 + 0.2316419 * z)) * (-0.356563782 + (1 / (1 + 0.2316419 * z)) * (1.781477937
  + (1 / (1 + 0.2316419 * z)) * (-1.821255978 + (1 / (1 + 0.2316419 * z)) * 1.330274429))))"""
TESTS = f"""SELECT d.metric, d.role, current - baseline AS effect, CASE WHEN observations >= need THEN least(1, 2 * {TAIL}) END AS p
  FROM (VALUES ('credits-per-developer-month', 'secondary', 5), ('credits-per-durable-change', 'secondary', 20), ('cost-centre-mix', 'secondary', 50),
    ('pr-throughput', 'guardrail', 20), ('cycle-time', 'guardrail', 20), ('revert-rate-7d', 'guardrail', 30), ('model-override-rate', 'guardrail', 50)) d(metric, role, need)
  LEFT JOIN (SELECT *, CASE WHEN baseline = 0 THEN 0 ELSE abs(current - baseline) / abs(baseline) END * sqrt(observations) AS z FROM observed) o USING (metric)"""


@query("e05_secondary_tests", """
SELECT t.metric, role, round(effect, 6) AS effect, round(t.p, 6) AS p_value, round(q, 6) AS q_value, coalesce(q <= 0.05, false) AS significant
FROM tests t LEFT JOIN (SELECT metric, least(1, min(p * m / i) OVER (ORDER BY p DESC, metric DESC)) AS q FROM (
  SELECT metric, p, row_number() OVER (ORDER BY p, metric) AS i, count(*) OVER () AS m FROM tests WHERE p IS NOT NULL)) USING (metric)""", **OBS, tests=TESTS)
def _(t):
    return rounded(HO.secondary_tests(observed(t)), 6)


PERIOD_DAYS = 90
STARTED = DEPLOYED // (PERIOD_DAYS * 86_400_000)


def rows(section: str, source: str, subject: str = "''", **figures: str) -> str:
    """Rows of a report: a figure's SQL is a number, or a label where its name ends with an underscore."""
    cells = ", ".join(
        f"{{'figure': '{name.rstrip('_')}', 'number': CAST({'NULL' if name.endswith('_') else value} AS DOUBLE), 'label': CAST({value if name.endswith('_') else 'NULL'} AS VARCHAR)}}"
        for name, value in figures.items()
    )
    return f"SELECT '{section}' AS section, CAST({subject} AS VARCHAR) AS subject, cell.figure, round(cell.number, 6) AS number, cell.label FROM (SELECT *, unnest([{cells}]) AS cell FROM {source})"


ITT = f"""SELECT author_id AS unit, CAST(floor(ts / ({PERIOD_DAYS} * 86400000.0)) AS BIGINT) AS period, avg(surviving_fraction) AS outcome
      FROM verdict WHERE fully_observed GROUP BY 1, 2"""
IN_ARMS = f"SELECT p.*, CASE WHEN a.arm = 'treated' THEN {STARTED} END AS treated_at FROM itt p LEFT JOIN assigned a USING (unit)"
ANALYSIS = OBS | {"guard": GUARD, "tests": TESTS} | upto("verdict") | drawn(7) | {"itt": ITT} | resampled(IN_ARMS) | dict(
    level="SELECT coalesce(stddev_samp(outcome), 0) AS sd, coalesce(avg(outcome), 0) AS baseline FROM itt",
    seen="SELECT count(*) FILTER (arm = 'treated') AS treated, count(*) FILTER (arm = 'holdout') AS holdout FROM (SELECT DISTINCT unit FROM itt) JOIN assigned USING (unit)",
    powered=f"SELECT *, {Z} * sd * sqrt(1 / treated + 1 / holdout) AS mde FROM level, seen",
    found="SELECT *, (high - low) / 2 AS half FROM average",
    tail="SELECT *, abs(effect) / (half / 1.959963984540054) AS z FROM found",
    judged=f"SELECT *, least(1, 2 * {TAIL}) AS p FROM tail",
    adjusted="""SELECT metric, least(1, min(p * m / i) OVER (ORDER BY p DESC, metric DESC)) AS q FROM (
      SELECT metric, p, row_number() OVER (ORDER BY p, metric) AS i, count(*) OVER () AS m FROM tests WHERE p IS NOT NULL)""",
    all_tests="SELECT t.*, q FROM tests t LEFT JOIN adjusted USING (metric)",
    balance="""SELECT *, (mt - mh) / sqrt((vt + vh) / 2) AS smd FROM (SELECT count(*) FILTER (arm = 'treated') AS t, count(*) FILTER (arm = 'holdout') AS h, avg(pre_spend) FILTER (arm = 'treated') AS mt,
      avg(pre_spend) FILTER (arm = 'holdout') AS mh, var_samp(pre_spend) FILTER (arm = 'treated') AS vt, var_samp(pre_spend) FILTER (arm = 'holdout') AS vh,
      sum(pre_spend) AS s, sum(pre_spend) FILTER (arm = 'holdout') AS sh, max(pre_spend) AS top FROM assigned)""",
    dropped="SELECT count(*) FILTER (b = 0 AND effect IS NULL) AS n FROM effects",
    counted="SELECT count(*) FILTER (treated_at IS NOT NULL) AS t, count(*) FILTER (treated_at IS NULL) AS c, count(DISTINCT treated_at) AS g, (SELECT n FROM dropped) AS d FROM units",
    said="""SELECT breaches, CASE WHEN breaches > 0 THEN 'guardrail-breach' WHEN (SELECT count(*) FROM judged) = 0 THEN 'no-estimate'
      WHEN (SELECT periods_tested = 0 OR violations > 0 FROM trend) THEN 'descriptive-only' WHEN (SELECT low <= 0 AND high >= 0 FROM judged) THEN 'no-detectable-effect' ELSE 'effect-detected' END AS v
      FROM (SELECT count(*) FILTER (status = 'breached') AS breaches FROM guard)""",
)
REPORT = " UNION ALL ".join([
    rows("registration", "(SELECT 1)", status_="'registered'"),
    rows("balance", "balance", treated_units="t", holdout_units="h", treated_mean="mt", holdout_mean="mh", smd="smd", balanced_="abs(smd) <= 0.1",
         holdout_spend_share="sh / s", holdout_headcount_share="h / (h + t)", top_unit_share="top / s", concentrated_="top / s >= greatest(0.25, 5 / (h + t))"),
    rows("power", "powered", sd="sd", baseline="baseline", treated="treated", holdout="holdout", mde="mde", mde_relative="mde / baseline"),
    rows("primary", "(SELECT 1) LEFT JOIN judged ON true", metric_="'effort-per-durable-change'", effect="effect", low="low", high="high", p_value="p", q_value="p",
         significant_="coalesce(low > 0 OR high < 0, false)"),
    rows("study", "study", "relative_period", effect="effect", low="low", high="high", units="units"),
    rows("trend", "trend", passes_="periods_tested > 0 AND violations = 0", untestable_="periods_tested = 0", periods_tested="periods_tested",
         violations="violations", worst_period="worst_period", worst_effect="worst_effect"),
    rows("summary", "counted", treated_units="t", control_units="c", cohorts="g", dropped_cells="d"),
    rows("secondary", "all_tests", "metric", role_="role", effect="effect", p_value="p", q_value="q", significant_="coalesce(q <= 0.05, false)"),
    rows("guardrails", "guard", "metric", baseline="baseline", current="current", observations="observations", adverse_movement="adverse", threshold="threshold", status_="status"),
    rows("unavailable", "(VALUES ('chat-abandonment'), ('developer-satisfaction')) m(metric)", "metric", reason_="'no record'"),
    rows("verdict", "said", breaches="breaches", verdict_="v"),
])


@query("e06_analyse_holdout", REPORT, **ANALYSIS)
def _(t):
    arms = HO.assign_holdout(t.roster, 7)
    return rounded(HO.analyse_holdout(arms, History(t).durability, observed(t), DEPLOYED, PERIOD_DAYS).report(), 6)


@query("e07_p_from_interval", f"""
SELECT c_custkey, round(2 * {TAIL}, 6) AS p_value FROM (SELECT c_custkey, abs(c_acctbal) / ((500 + c_custkey % 900) / 1.959963984540054) AS z FROM customer)""")
def _(t):
    half = 500 + F.col("c_custkey") % 900
    point = F.col("c_acctbal")
    return rounded(t.raw("customer").select("c_custkey", HO.p_from_interval(point, point - half, point + half).alias("p_value")), 6)


MONTHS = """SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) FILTER (o_custkey % 7 <> 0) AS treated_mean, avg(o_totalprice) FILTER (o_custkey % 7 = 0) AS holdout_mean,
  count(DISTINCT o_custkey) FILTER (o_custkey % 7 <> 0) AS treated_units, count(DISTINCT o_custkey) FILTER (o_custkey % 7 = 0) AS holdout_units, CAST(count(*) * 100 AS DOUBLE) AS simulated_credits FROM orders GROUP BY 1"""


def months(t):
    held = F.col("o_custkey") % 7 == 0
    return t.raw("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.avg(F.when(~held, F.col("o_totalprice"))).alias("treated_mean"), F.avg(F.when(held, F.col("o_totalprice"))).alias("holdout_mean"),
        F.countDistinct(F.when(~held, F.col("o_custkey"))).alias("treated_units"), F.countDistinct(F.when(held, F.col("o_custkey"))).alias("holdout_units"),
        (F.count(F.lit(1)) * 100).cast("double").alias("simulated_credits"),
    )


@query("a33_savings_pnl", """
SELECT month, round(treated_mean, 4) AS treated_mean, round(holdout_mean, 4) AS holdout_mean, treated_units, holdout_units, round(simulated_credits, 4) AS simulated_credits,
  round(r, 4) AS realised_credits, round(r - simulated_credits, 4) AS gap_credits, round(CASE WHEN ok THEN (r - simulated_credits) / simulated_credits END, 4) AS gap_ratio, ok AS estimable
FROM (SELECT *, treated_units > 0 AND holdout_units > 0 AS ok, CASE WHEN treated_units > 0 AND holdout_units > 0 THEN (holdout_mean - treated_mean) * treated_units ELSE 0 END AS r FROM m)""", m=MONTHS)
def _(t):
    return rounded(HO.savings_pnl(months(t)))


@query("a33_pnl_calibration", """
SELECT count(*) AS months, round(sum(simulated_credits), 2) AS simulated_credits, round(sum(r), 2) AS realised_credits, round(sum(r) / sum(simulated_credits), 2) AS calibration,
  CASE WHEN sum(r) / sum(simulated_credits) < 0.8 THEN 'over-promised' WHEN sum(r) / sum(simulated_credits) > 1.2 THEN 'under-promised' ELSE 'accurate' END AS verdict
FROM (SELECT *, (holdout_mean - treated_mean) * treated_units AS r FROM m WHERE treated_units > 0 AND holdout_units > 0)""", m=MONTHS)
def _(t):
    return rounded(HO.pnl_calibration(HO.savings_pnl(months(t))), 2)


@query("a32_model_overrides", f"""SELECT count(*) AS considered, count(*) FILTER (model IN ('2-HIGH', '4-NOT SPECIFIED')) AS on_routed,
  count(*) FILTER (model NOT IN ('2-HIGH', '4-NOT SPECIFIED')) AS overrides, round(count(*) FILTER (model NOT IN ('2-HIGH', '4-NOT SPECIFIED')) / count(*), 6) AS override_rate FROM request WHERE ts >= {DEPLOYED}""")
def _(t):
    return rounded(HO.model_overrides(t.request, "2-HIGH", ["4-NOT SPECIFIED"], DEPLOYED), 6)


@query("a32_override_tally", f"SELECT model, count(*) AS requests, round(count(*) / (SELECT count(*) FROM request WHERE ts >= {DEPLOYED}), 6) AS share FROM request WHERE ts >= {DEPLOYED} GROUP BY 1")
def _(t):
    return rounded(HO.override_tally(t.request, DEPLOYED), 6)
