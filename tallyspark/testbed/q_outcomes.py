"""Registered queries: git outcomes and survival."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..operators import survival as SV
from ..session import attach
from .registry import query, rounded

NOW_MS = 996_710_400_000  # 2001-08-02, the day after the last order


class History:
    def __init__(self, t) -> None:
        self.t = t

    @cached_property
    def changes(self):
        return O.file_changes(self.t.commit, self.t.commit_file)

    @cached_property
    def matches(self):
        return O.attribute_deletions(self.changes)

    @cached_property
    def durability(self):
        return O.measure_durability(self.t.commit, self.changes, self.matches, NOW_MS)

    @cached_property
    def observations(self):
        return O.survival_observations(self.changes, self.matches, NOW_MS)


H = dict(
    touched="SELECT f.*, c.ts, c.author_id FROM commit_file f JOIN commit_log c USING (sha) WHERE NOT is_merge",
    ev="""SELECT path_hash, sha, ts, phase, lines, sum(CASE WHEN phase = 1 THEN lines ELSE -lines END) OVER (PARTITION BY path_hash ORDER BY ts, sha, phase) AS s
      FROM (SELECT path_hash, sha, ts, 0 AS phase, deleted AS lines FROM touched UNION ALL SELECT path_hash, sha, ts, 1, added FROM touched) WHERE lines > 0""",
    height="""SELECT *, s - least(0, min(s) OVER (PARTITION BY path_hash ORDER BY ts, sha, phase ROWS UNBOUNDED PRECEDING)) AS h FROM ev""",
    step="SELECT *, lag(h, 1, 0) OVER (PARTITION BY path_hash ORDER BY ts, sha, phase) AS hp FROM height",
    levels="SELECT path_hash, sha, ts, phase, unnest(range(CAST(least(h, hp) AS BIGINT), CAST(greatest(h, hp) AS BIGINT))) AS lvl FROM step",
    pairs="""SELECT *, lag(sha) OVER w AS change_id, lag(ts) OVER w AS added_ts FROM levels
      WINDOW w AS (PARTITION BY path_hash, lvl ORDER BY ts, sha, phase)""",
    matched="""SELECT path_hash, change_id, added_ts, ts AS deleted_ts, count(*) AS lines FROM pairs
      WHERE phase = 0 AND ts - added_ts <= 2592000000 GROUP BY ALL""",
    per_change="SELECT sha, sum(added) AS added, sum(deleted) AS deleted, count(*) AS files FROM touched GROUP BY 1",
    churn="SELECT change_id AS sha, sum(lines) AS churn FROM matched GROUP BY 1",
    durability=f"""SELECT c.sha AS change_id, author_id, ts, pull_request, coalesce(added, 0) AS lines_added, coalesce(deleted, 0) AS lines_deleted,
      coalesce(files, 0) AS files_touched, least(coalesce(churn, 0), coalesce(added, 0)) AS lines_churned,
      c.sha IN (SELECT reverts_sha FROM commit_log WHERE reverts_sha IS NOT NULL) AS reverted, {NOW_MS} - ts >= 2592000000 AS fully_observed
      FROM commit_log c LEFT JOIN per_change USING (sha) LEFT JOIN churn USING (sha) WHERE NOT is_merge""",
    verdict="""SELECT *, lines_added - lines_churned AS lines_surviving,
      CASE WHEN lines_added > 0 THEN (lines_added - lines_churned) / lines_added ELSE 1 END AS surviving_fraction,
      CASE WHEN fully_observed THEN NOT reverted AND CASE WHEN lines_added > 0 THEN (lines_added - lines_churned) / lines_added ELSE 1 END >= 0.5 END AS durable FROM durability""",
    observed=f"""SELECT (deleted_ts - added_ts) / 86400000 AS duration, true AS event, CAST(sum(lines) AS DOUBLE) AS weight FROM matched GROUP BY 1
      UNION ALL SELECT least(30, ({NOW_MS} - ts) / 86400000), false, CAST(sum(added - coalesce(gone, 0)) AS DOUBLE) FROM touched t
      LEFT JOIN (SELECT path_hash, change_id, sum(lines) AS gone FROM matched GROUP BY 1, 2) m ON m.path_hash = t.path_hash AND m.change_id = t.sha
      WHERE added > coalesce(gone, 0) GROUP BY 1""",
)
_names = list(H)


def upto(name: str) -> dict[str, str]:
    return {n: H[n] for n in _names[: _names.index(name) + 1]}


def km_ctes(source: str) -> dict[str, str]:
    return dict(
        km_time=f"""SELECT duration AS time, coalesce(sum(weight) FILTER (event), 0) AS events, coalesce(sum(weight) FILTER (NOT event), 0) AS censored
          FROM {source} WHERE duration >= 0 AND weight > 0 GROUP BY 1""",
        km_risk="SELECT *, sum(events + censored) OVER () AS subjects, sum(events + censored) OVER (ORDER BY time DESC) AS at_risk FROM km_time",
        km="""SELECT *, product(1 - events / at_risk) OVER (ORDER BY time) AS survival,
          sum(CASE WHEN at_risk > events THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER (ORDER BY time) AS greenwood FROM km_risk""",
    )


KM_SELECT = """SELECT time, round(survival, 8) AS survival, round(survival * sqrt(greenwood), 8) AS standard_error, round(at_risk, 8) AS at_risk,
  round(events, 8) AS events, round(censored, 8) AS censored, round(at_risk - events - censored, 8) AS remaining, round(subjects, 8) AS subjects FROM km"""


@query("o01_attribute_deletions", """
SELECT path_hash, change_id, deleted_ts, lines FROM matched""", **upto("matched"))
def _(t):
    return History(t).matches.groupBy("path_hash", "change_id", "deleted_ts").agg(F.sum("lines").alias("lines"))


@query("o01_measure_durability", """
SELECT change_id, author_id, ts, pull_request, CAST(lines_added AS BIGINT) AS lines_added, CAST(lines_deleted AS BIGINT) AS lines_deleted, files_touched,
  CAST(lines_churned AS BIGINT) AS lines_churned, reverted, fully_observed, CAST(lines_surviving AS BIGINT) AS lines_surviving,
  round(surviving_fraction, 8) AS surviving_fraction, durable FROM verdict""", **upto("verdict"))
def _(t):
    return rounded(History(t).durability, 8)


@query("o01_survival_observations", """
SELECT round(duration, 8) AS duration, event, round(weight, 8) AS weight FROM observed""", **upto("observed"))
def _(t):
    return rounded(History(t).observations, 8)


@query("j11_reverted_commits", """
SELECT sha, ts FROM commit_log WHERE sha IN (SELECT reverts_sha FROM commit_log)""")
def _(t):
    wanted = t.commit.where(F.col("reverts_sha").isNotNull()).select(F.col("reverts_sha").alias("sha"))
    return t.commit.join(wanted, "sha", "left_semi").select("sha", "ts")


@query("a34_durability_summary", """
SELECT count(*) AS changes, count(*) FILTER (durable) AS durable, count(*) FILTER (NOT durable) AS not_durable, count(*) FILTER (durable IS NULL) AS unknown,
  CAST(sum(lines_surviving) FILTER (fully_observed) AS BIGINT) AS durable_line_equivalents,
  round(count(*) FILTER (durable) / count(durable), 8) AS durable_rate FROM verdict""", **upto("verdict"))
def _(t):
    return rounded(O.summarise_durability(History(t).durability), 8)


HOURS = """SELECT *, CASE WHEN ts - prev <= 7200000 THEN (ts - prev) / 3600000 ELSE 0.5::DOUBLE END AS hours FROM (
  SELECT *, lag(ts) OVER (PARTITION BY author_id ORDER BY ts, sha) AS prev FROM commit_log WHERE NOT is_merge)"""


@query("v05_author_hours", "SELECT sha, author_id, round(hours, 6) AS hours FROM h", h=HOURS)
def _(t):
    return rounded(O.author_hours(t.commit).select("sha", "author_id", "hours"), 6)


LATENCY = """SELECT m.sha, (m.ts - max(p.ts)) / 3600000 AS latency_hours FROM (SELECT sha, ts, unnest(parents[2:]) AS parent FROM commit_log WHERE is_merge) m
  JOIN commit_log p ON p.sha = m.parent GROUP BY m.sha, m.ts HAVING m.ts >= max(p.ts)"""


@query("v06_review_latencies", "SELECT sha, round(latency_hours, 6) AS latency_hours FROM l", l=LATENCY)
def _(t):
    return rounded(O.review_latencies(t.commit), 6)


@query("v06_median_review_latency", "SELECT round(median(latency_hours), 6) AS median_hours FROM l", l=LATENCY)
def _(t):
    from ..functions.quantiles import med_mid

    return rounded(med_mid(O.review_latencies(t.commit), "latency_hours", "median_hours"), 6)


@query("v07_familiarity", """
SELECT sha, round(avg(CASE WHEN (first_ts, first_sha) < (ts, sha) THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS familiarity FROM (
  SELECT *, first_value(ts) OVER w AS first_ts, first_value(sha) OVER w AS first_sha FROM touched
  WINDOW w AS (PARTITION BY author_id, path_hash ORDER BY ts, sha)) GROUP BY sha""", **upto("touched"))
def _(t):
    return rounded(O.familiarity(t.commit, t.commit_file), 8)


def effort_sql(window: str) -> str:
    return f"""SELECT sum(CASE WHEN reverts_sha IS NOT NULL THEN 0 ELSE hours * (1 - share) END) AS author, sum(CASE WHEN reverts_sha IS NOT NULL THEN 0 ELSE hours * share END) AS rework,
  sum(CASE WHEN reverts_sha IS NOT NULL THEN hours ELSE 0 END) AS failure FROM (
    SELECT h.*, CASE WHEN touched > 0 AND gone > 0 THEN least(1, gone / touched) ELSE 0 END AS share
    FROM (SELECT *, CASE WHEN ts - prev <= 7200000 THEN (ts - prev) / 3600000 ELSE 0.5::DOUBLE END AS hours FROM (
      SELECT *, lag(ts) OVER (PARTITION BY author_id ORDER BY ts, sha) AS prev FROM commit_log WHERE NOT is_merge AND {window})) h
    LEFT JOIN (SELECT sha, sum(added + deleted) AS touched, sum(deleted) AS gone FROM commit_file GROUP BY 1) USING (sha) WHERE hours > 0)"""


@query("o02_decompose_effort", """
SELECT round(author, 6) AS author_hours, round(rework, 6) AS rework_hours, round(failure, 6) AS failure_hours,
  round(author + rework + failure, 6) AS measurable_hours, round((rework + failure) / author, 6) AS rework_ratio FROM e""", e=effort_sql("true"))
def _(t):
    return rounded(O.decompose_effort(t.commit, t.commit_file, History(t).durability), 6)


SPAN = 90 * 86_400_000
RECENT = f"ts >= {NOW_MS - SPAN} AND ts < {NOW_MS}"
PRIOR = f"ts >= {NOW_MS - 2 * SPAN} AND ts < {NOW_MS - SPAN}"


def window_facts(window: str) -> str:
    return f"""SELECT count(*) AS changes, avg(surviving_fraction) FILTER (fully_observed AND lines_added > 0) AS survival, avg(lines_added) AS size,
  avg(CASE WHEN reverted THEN 1.0 ELSE 0.0 END) AS reverts, (SELECT count(*) FROM commit_log WHERE {window}) AS commits,
  (SELECT avg(hours) FROM (SELECT (m.ts - max(p.ts)) / 3600000 AS hours FROM (SELECT sha, ts, unnest(parents[2:]) AS parent FROM commit_log WHERE is_merge AND {window}) m
    JOIN (SELECT sha, ts FROM commit_log WHERE {window}) p ON p.sha = m.parent GROUP BY m.sha, m.ts HAVING m.ts >= max(p.ts))) AS latency
  FROM verdict WHERE {window}"""


@query("o03_detect_displacement", """
SELECT recent_changes, prior_changes, pd2, pd3, pd4, pd5, round((recent_changes + prior_changes) / (recent_changes + prior_changes + 100), 6) AS pd2_confidence,
  round(commits / (commits + 200), 6) AS pd3_confidence, round(commits / (commits + 200), 6) AS pd4_confidence,
  round((recent_changes + prior_changes) / (recent_changes + prior_changes + 200), 6) AS pd5_confidence,
  pd2 IS NOT NULL AND recent_changes > prior_changes AND pd4 IS NOT NULL AS composite_alarm
FROM (SELECT r.changes AS recent_changes, p.changes AS prior_changes, r.commits,
  round(CASE WHEN p.survival > r.survival THEN p.survival - r.survival END, 6) AS pd2,
  round(CASE WHEN r.size / p.size - 1 > 0.1 AND r.latency / p.latency - 1 < r.size / p.size - 1 THEN r.size / p.size - r.latency / p.latency END, 6) AS pd3,
  round(CASE WHEN (er.rework + er.failure) / er.author > (ep.rework + ep.failure) / ep.author THEN (er.rework + er.failure) / er.author - (ep.rework + ep.failure) / ep.author END, 6) AS pd4,
  round(CASE WHEN r.reverts > p.reverts THEN r.reverts - p.reverts END, 6)::DOUBLE AS pd5
  FROM facts_r r, facts_p p, effort_r er, effort_p ep)""",
    **upto("verdict"), facts_r=window_facts(RECENT), facts_p=window_facts(PRIOR), effort_r=effort_sql(RECENT), effort_p=effort_sql(PRIOR))
def _(t):
    return rounded(O.detect_displacement(t.commit, t.commit_file, History(t).durability, NOW_MS), 6)


@query("o04_outcome_report", """
SELECT (SELECT count(*) FROM verdict) AS changes, (SELECT count(*) FILTER (durable) FROM verdict) AS durable,
  (SELECT count(DISTINCT author_id) FROM commit_log) AS authors, round((SELECT CASE WHEN x.remaining >= 10 THEN x.survival END FROM at_horizon), 6) AS survival_at_horizon,
  round(author + rework + failure, 6) AS measurable_hours, round((SELECT median(latency_hours) FROM l), 6) AS median_review_latency_hours,
  round((author + rework + failure) / (SELECT count(*) FILTER (durable) FROM verdict), 6) AS hours_per_durable_change,
  round((SELECT sum(lines) FROM matched) / (SELECT sum(deleted) FROM touched), 6) AS attribution_coverage FROM e""",
    **upto("observed"), **km_ctes("observed"),
    # Withheld where fewer than ten lines are still observed after the last time up to the horizon.
    at_horizon="SELECT arg_max({'survival': survival, 'remaining': at_risk - events - censored}, time) AS x FROM km WHERE time <= 30", l=LATENCY, e=effort_sql("true"))
def _(t):
    out = O.outcome_report(t.commit, t.commit_file, NOW_MS)
    return rounded(out.select("changes", "durable", "authors", "survival_at_horizon", "measurable_hours",
                              "median_review_latency_hours", "hours_per_durable_change", "attribution_coverage"), 6)


@query("v09_kaplan_meier_code", KM_SELECT, **upto("observed"), **km_ctes("observed"))
def _(t):
    return rounded(SV.kaplan_meier(History(t).observations), 8)


@query("v09_kaplan_meier", KM_SELECT, **km_ctes("survival"))
def _(t):
    return rounded(SV.kaplan_meier(t.survival), 8)


@query("v10_survival_at", """
SELECT round((SELECT arg_max(survival, time) FROM km WHERE time <= 60), 8) AS survival,
  round((SELECT arg_max(at_risk - events - censored, time) FROM km WHERE time <= 60), 8) AS at_risk,
  (SELECT arg_max(at_risk - events - censored, time) FROM km WHERE time <= 60) >= 10 AS estimable""", **km_ctes("survival"))
def _(t):
    return rounded(SV.survival_at(SV.kaplan_meier(t.survival), 60), 8)


@query("v11_log_rank", """
SELECT round((o - e) ** 2 / v, 6) AS chi_square, round(o, 6) AS observed_a, round(e, 6) AS expected_a, true AS comparable
FROM (SELECT sum(d_a) AS o, sum(d * n_a / n) AS e, sum(d * n_a * n_b * (n - d) / (n * n * (n - 1))) AS v FROM (
  SELECT d_a, d_a + d_b AS d, sum(g_a) OVER w AS n_a, sum(g_b) OVER w AS n_b, sum(g_a + g_b) OVER w AS n FROM (
    SELECT duration, coalesce(sum(weight) FILTER (arm = 'F' AND event), 0) AS d_a, coalesce(sum(weight) FILTER (arm <> 'F' AND event), 0) AS d_b,
      coalesce(sum(weight) FILTER (arm = 'F'), 0) AS g_a, coalesce(sum(weight) FILTER (arm <> 'F'), 0) AS g_b FROM survival GROUP BY 1)
  WINDOW w AS (ORDER BY duration DESC)) WHERE d > 0 AND n > 1)""")
def _(t):
    out = SV.log_rank(t.survival, F.col("arm") == "F")
    return rounded(out.drop("p_value"), 6)


@query("a35_build_panel", """
SELECT author_id AS unit, CAST(floor(ts / 2592000000) AS BIGINT) AS period, round(avg(surviving_fraction) FILTER (fully_observed AND lines_added > 0), 8) AS outcome,
  count(*) AS changes FROM verdict GROUP BY 1, 2 HAVING count(*) FILTER (fully_observed AND lines_added > 0) > 0""", **upto("verdict"))
def _(t):
    return rounded(O.build_panel(History(t).durability, F.col("author_id"), period_days=30), 8)
