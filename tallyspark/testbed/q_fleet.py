"""Registered queries: fleet, drift, privacy, policy, scope and composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fleet as FL
from ..operators import policy as PO
from ..operators import privacy as PR
from ..operators import scope as SC
from ..plans import reports as R
from .q_waste import corpus_of
from .registry import query, rounded

INSTALL = "o_custkey % 200"


def bundles(t, where=None):
    o = t.raw("orders") if where is None else t.raw("orders").where(where)
    install = F.col("o_custkey") % 200
    o = o.withColumn("install_id", install).withColumn("credits", F.col("o_totalprice") / 1000)
    measured = F.when(F.col("o_orderkey") % 4 == 0, F.col("credits")).otherwise(0.0)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    totals = o.groupBy("install_id").agg(
        F.sum("credits").alias("total_credits"), F.sum(measured).alias("measured_credits"), F.count(F.lit(1)).alias("request_count"),
        F.min(day).alias("period_from"), F.max(day).alias("period_to"),
    ).withColumn("modelled_credits", F.col("total_credits") - F.col("measured_credits")).withColumn(
        "team", F.concat(F.lit("t"), F.col("install_id") % 90)).withColumn("developers", 1 + F.col("install_id") % 3)
    money = [F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("requests")]
    lines = t.raw("lineitem").join(o.select("o_orderkey", "install_id"), F.col("l_orderkey") == F.col("o_orderkey"))
    return FL.build_bundle(
        totals,
        o.groupBy("install_id", F.col("o_orderpriority").alias("model")).agg(*money),
        o.groupBy("install_id", F.col("o_orderstatus").alias("label")).agg(*money),
        o.groupBy("install_id", F.concat(F.lit("W"), F.col("o_orderkey") % 5 + 1).alias("class")).agg(*money).withColumn("confidence", F.lit(0.5)),
        lines.groupBy("install_id", F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("server")).agg(
            F.countDistinct(F.col("l_partkey") % 40).alias("tool_count"), F.count(F.lit(1)).alias("invocations")),
        o.groupBy("install_id", day.alias("day")).agg(*money),
    )


FB = dict(
    ord="SELECT *, o_custkey % 200 AS install_id, o_totalprice / 1000 AS credits FROM orders",
    inst="""SELECT install_id, sum(credits) AS total, sum(credits) FILTER (o_orderkey % 4 = 0) AS measured, count(*) AS n, 't' || (install_id % 90) AS team, 1 + install_id % 3 AS developers,
      strftime(min(o_orderdate), '%Y-%m-%d') AS f, strftime(max(o_orderdate), '%Y-%m-%d') AS u FROM ord GROUP BY install_id""",
    surface="""SELECT install_id, 's' || (l_suppkey % 7) AS server, count(DISTINCT l_partkey % 40) AS tools, count(*) AS calls FROM lineitem JOIN ord ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)


@query("a29_build_bundle", """
SELECT i.install_id, round(total, 4) AS total_credits, n AS request_count, (SELECT count(DISTINCT o_orderpriority) FROM ord o WHERE o.install_id = i.install_id) AS models,
  (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM ord o WHERE o.install_id = i.install_id) AS days, (SELECT count(*) FROM surface s WHERE s.install_id = i.install_id) AS servers FROM inst i""", **FB)
def _(t):
    return rounded(bundles(t).select(
        "install_id", "total_credits", "request_count", F.size("by_model").cast("long").alias("models"),
        F.size("daily").cast("long").alias("days"), F.size("tool_surface").cast("long").alias("servers")))


@query("a24_fleet_rollup", """
SELECT count(*) AS installs, CAST(sum(developers) AS BIGINT) AS developers, round(sum(total), 4) AS total_credits, round(sum(measured) / sum(total), 4) AS measured_share,
  CAST(sum(n) AS BIGINT) AS request_count, min(f) AS period_from, max(u) AS period_to, true AS extrapolation_retired FROM inst""", **FB)
def _(t):
    return rounded(FL.fleet_rollup(bundles(t)))


@query("a25_rollup_teams", """
SELECT CASE WHEN sum(developers) < 5 THEN 'withheld (<5 developers)' ELSE team END AS team, CAST(sum(developers) AS BIGINT) AS developers, count(*) AS installs,
  round(sum(total), 4) AS credits, CAST(sum(n) AS BIGINT) AS requests, round(sum(total) / sum(developers), 4) AS credits_per_developer, sum(developers) < 5 AS suppressed FROM inst i GROUP BY i.team""", **FB)
def _(t):
    return rounded(FL.rollup_teams(bundles(t)))


@query("a26_rollup_models", "SELECT o_orderpriority AS model, round(sum(credits), 2) AS credits, count(*) AS requests, round(sum(credits) / (SELECT sum(credits) FROM ord), 2) AS share FROM ord GROUP BY 1", **FB)
def _(t):
    return rounded(FL.rollup_models(bundles(t)), 2)


@query("a26_rollup_waste", """SELECT 'W' || (o_orderkey % 5 + 1) AS class, round(sum(credits), 4) AS credits, count(DISTINCT install_id) AS installs_affected,
  round(sum(credits) / (SELECT sum(credits) FROM ord), 4) AS share FROM ord GROUP BY 1""", **FB)
def _(t):
    return rounded(FL.rollup_waste(bundles(t)))


@query("a26_rollup_tool_surface", """SELECT server, count(*) AS installs, max(tools) AS tool_count, CAST(sum(calls) AS BIGINT) AS invocations, round(sum(calls) / count(*), 4) AS invocations_per_install FROM surface GROUP BY 1""", **FB)
def _(t):
    return rounded(FL.rollup_tool_surface(bundles(t)))


@query("a27_spend_distribution", """
SELECT count(*) AS installs, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.1), 4) AS p10, round(quantile_cont(x, 0.9), 4) AS p90,
  round(quantile_cont(x, 0.99), 4) AS p99, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 4) AS gini,
  round(sum(x) FILTER (i > n - greatest(1, ceil(n * 0.1))) / sum(x), 4) AS top_decile_share, true AS estimable
FROM (SELECT x, row_number() OVER (ORDER BY x, install_id) AS i, count(*) OVER () AS n FROM (SELECT install_id, total / developers AS x FROM inst))""", **FB)
def _(t):
    return rounded(FL.spend_distribution(bundles(t)))


@query("a28_executive_report", """
SELECT count(*) AS installs, round(sum(total) / sum(developers), 4) AS credits_per_developer,
  (SELECT string_agg(m, ',' ORDER BY c DESC) FROM (SELECT o_orderpriority AS m, sum(credits) AS c FROM ord GROUP BY 1)) AS top_models,
  (SELECT count(*) FROM (SELECT team FROM inst GROUP BY team HAVING sum(developers) < 5)) AS suppressed_teams FROM inst""", **FB)
def _(t):
    out = FL.executive_report(bundles(t))
    return rounded(out.select("installs", "credits_per_developer", F.array_join(F.transform("top_model", lambda m: m["model"]), ",").alias("top_models"), "suppressed_teams"))


def drift(t):
    early, late = F.col("o_orderdate") < "1996-01-01", (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderpriority") != "5-LOW")
    fitted = FL.fit_snapshot(bundles(t, early & (F.col("o_orderpriority") != "1-URGENT")))
    return FL.detect_drift(fitted.where(F.col("subject") != "s6"), FL.fit_snapshot(bundles(t, late)))


DRIFT = dict(
    ord=FB["ord"],
    e="SELECT * FROM ord WHERE o_orderdate < '1996-01-01' AND o_orderpriority <> '1-URGENT'",
    l="SELECT * FROM ord WHERE o_orderdate >= '1996-01-01' AND o_orderpriority <> '5-LOW'",
    es="SELECT server, max(tools) AS v FROM (SELECT install_id, 's' || (l_suppkey % 7) AS server, count(DISTINCT l_partkey % 40) AS tools FROM lineitem JOIN e ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1",
    ls="SELECT server, max(tools) AS v FROM (SELECT install_id, 's' || (l_suppkey % 7) AS server, count(DISTINCT l_partkey % 40) AS tools FROM lineitem JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1",
    findings="""SELECT 'new-model' AS finding, o_orderpriority AS subject, sum(credits) / (SELECT sum(credits) FROM l) AS magnitude FROM l WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM e) GROUP BY 2
      UNION ALL SELECT 'retired-model', o_orderpriority, 0 FROM e WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM l) GROUP BY 2
      UNION ALL SELECT 'new-server', server, v FROM ls WHERE server = 's6'
      UNION ALL SELECT 'tool-surface', 'tool surface', g FROM (SELECT ((SELECT sum(v) FROM ls) - (SELECT sum(v) FROM es)) / (SELECT sum(v) FROM es) AS g) WHERE abs(g) >= 0.25
      UNION ALL SELECT 'volume', 'credit volume', g FROM (SELECT ((SELECT sum(credits) FROM l) - (SELECT sum(credits) FROM e)) / (SELECT sum(credits) FROM e) AS g) WHERE abs(g) >= 0.5""",
)


@query("a31_detect_drift", "SELECT finding, subject, round(magnitude, 4)::DOUBLE AS magnitude FROM findings", **DRIFT)
def _(t):
    return rounded(drift(t))


@query("a31_drift_summary", """SELECT count(*) AS findings, 30 AS days_since_fit, round(coalesce(sum(magnitude) FILTER (finding = 'new-model'), 0), 4)::DOUBLE AS unseen_share, true AS refit_recommended FROM findings""", **DRIFT)
def _(t):
    day = lambda d: F.to_date(F.lit(d))
    return rounded(FL.drift_summary(drift(t), ["2-HIGH"], day("2001-07-02"), day("2001-08-01")))


SERIES = "SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS credits FROM events WHERE value IS NOT NULL GROUP BY 1, 2"


@query("v04_spend_anomalies", """
SELECT event_type, day, round(credits, 4) AS credits, round(expected, 4) AS expected, round(z, 4) AS robust_z, CASE WHEN abs(z) >= 3 THEN 'critical' ELSE 'warning' END AS severity
FROM (SELECT *, 0.6745 * (credits - expected) / median(abs(credits - expected)) OVER (PARTITION BY event_type) AS z FROM (SELECT *, median(credits) OVER (PARTITION BY event_type) AS expected FROM s)) WHERE abs(z) >= 1.5""", s=SERIES)
def _(t):
    days = t.raw("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("credits"))
    return rounded(FL.spend_anomalies(days, threshold=1.5, by=["event_type"]))


@query("p01_k_anonymise", """SELECT CASE WHEN count(DISTINCT user_id) < 5 THEN 'withheld (<5 developers)' ELSE question_hash END AS question_hash, count(DISTINCT user_id) AS people, round(sum(value), 4) AS credits, count(DISTINCT user_id) < 5 AS suppressed
FROM (SELECT *, event_type || '-' || CAST(floor(value / 5) AS BIGINT) AS question_hash FROM events) e GROUP BY e.question_hash""")
def _(t):
    q = t.question.groupBy("question_hash").agg(F.countDistinct("asked_by").alias("people"), F.sum("credits").alias("credits"))
    return rounded(PR.k_anonymise(q, "question_hash", F.col("people")))


@query("p02_audit_shareable", """SELECT '$.session_id' AS field, count(*) AS violations FROM orders
UNION ALL SELECT '$.files[].path', count(*) FILTER (o_orderkey % 10 = 0) FROM orders UNION ALL SELECT '$.source_file', count(*) FILTER (o_orderkey % 3 = 0) FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    report = t.raw("orders").select(
        F.col("o_custkey").alias("session_id"), F.when(key % 3 == 0, "C:\\Users\\x").otherwise("ws/chat.jsonl").alias("source_file"),
        F.array(F.struct(F.when(key % 10 == 0, "/home/me/a.py").otherwise("src/a.py").alias("path"), key.alias("n"))).alias("files"))
    return PR.audit_shareable(report)


@query("p04_audit_manifest", "SELECT count(*) AS bundles, 'day_names' AS undeclared FROM inst", **FB)
def _(t):
    extended = bundles(t).withColumn("day_names", F.transform("daily", lambda d: d["day"]))
    names = PR.audit_manifest(extended, FL.BUNDLE_FIELDS, ("bundle_version", "manifest"))
    return extended.agg(F.count(F.lit(1)).alias("bundles")).withColumn("undeclared", F.lit(",".join(names)))


SETTINGS = dict(
    want="SELECT c_custkey AS machine, s AS setting, 'on' AS intended FROM customer, (VALUES ('a'), ('b')) v(s)",
    have="SELECT c_custkey AS machine, s AS setting, CASE WHEN c_custkey % 4 = 1 THEN 'off' ELSE 'on' END AS effective FROM customer, (VALUES ('a'), ('b')) v(s) WHERE c_custkey % 5 <> 0 AND NOT (s = 'b' AND c_custkey % 3 = 0)",
    status="""SELECT w.machine, w.setting, intended, effective, CASE WHEN w.machine NOT IN (SELECT machine FROM have) THEN 'unverifiable' WHEN effective IS NULL THEN 'missing' WHEN effective = intended THEN 'applied' ELSE 'differs' END AS status
      FROM want w LEFT JOIN have h ON h.machine = w.machine AND h.setting = w.setting""",
)


def settings(t):
    key = F.col("c_custkey")
    base = t.raw("customer").select(key.alias("machine"), key, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("setting"))
    want = base.select("machine", "setting", F.lit("on").alias("intended"))
    have = base.where((key % 5 != 0) & ~((F.col("setting") == "b") & (key % 3 == 0))).select(
        "machine", "setting", F.when(key % 4 == 1, "off").otherwise("on").alias("effective"))
    return PO.verify_settings(want, have, ["machine"])


@query("j15_verify_settings", "SELECT machine, setting, intended, effective, status FROM status", **SETTINGS)
def _(t):
    return settings(t)


@query("p05_policy_compliance", """SELECT machine, count(*) AS lines, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'missing') AS missing,
  count(*) FILTER (status = 'differs') AS differs, count(*) FILTER (status = 'unverifiable') AS unverifiable, bool_and(status = 'applied') AS ok FROM status GROUP BY 1""", **SETTINGS)
def _(t):
    return PO.policy_compliance(settings(t), ["machine"])


@query("a37_derive_agents", """
SELECT regexp_replace(lead, '[^a-zA-Z0-9]+', '-', 'g') || '-tasks' AS name, string_agg(name, ',' ORDER BY name) AS tools, CAST(NULL AS VARCHAR) AS model, n AS requests_covered, round(n / total, 6) AS coverage
FROM (SELECT lead, name, count(*) AS seen, any_value(n) AS n, any_value(total) AS total FROM lt JOIN (SELECT lead, count(*) AS n, (SELECT count(*) FROM leads) AS total FROM leads GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 5) USING (lead) GROUP BY 1, 2)
WHERE seen / n >= 0.2 GROUP BY lead, n, total
UNION ALL SELECT 'retrieval', 'read_file', (SELECT cheapest_model FROM cheapest), 0, 0""",
    per="SELECT request_id, name, count(*) AS n FROM tool_call GROUP BY 1, 2",
    leads="SELECT request_id, arg_min(name, (-n, name)) AS lead FROM per GROUP BY 1",
    lt="SELECT lead, request_id, name FROM per JOIN leads USING (request_id)")
def _(t):
    return rounded(PO.derive_agents(corpus_of(t)).withColumn("tools", F.array_join("tools", ",")), 6)


URL = "SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS raw FROM pages"
TREE = dict(
    u=URL,
    ws="""SELECT 'w' || page_id AS workspace_id, CASE WHEN page_id % 9 > 0 THEN lower(regexp_replace(raw, '/[^/]*$', '')) END AS folder,
      CASE WHEN page_id % 9 = 0 THEN 'empty-window' END AS reason, CAST(page_id % 100 AS DOUBLE) AS credits, page_id % 7 AS requests FROM u""",
    own="SELECT folder, count(*) AS n, sum(credits) AS c, sum(requests) AS r FROM ws WHERE reason IS NULL GROUP BY 1",
    tree="""SELECT a.folder, any_value(a.n) AS workspaces, any_value(a.c) AS own_credits, any_value(a.r) AS own_requests, sum(b.c) AS subtree_credits, sum(b.r) AS subtree_requests,
      (SELECT arg_max(p.folder, length(p.folder)) FROM own p WHERE starts_with(a.folder, p.folder || '/')) AS parent
      FROM own a JOIN own b ON b.folder = a.folder OR starts_with(b.folder, a.folder || '/') GROUP BY a.folder""",
)


def locations(t):
    raw = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    lost = F.col("page_id") % 9 == 0
    return t.raw("pages").select(
        F.concat(F.lit("w"), "page_id").alias("workspace_id"),
        F.when(~lost, S.canonicalise_path(F.regexp_replace(raw, "/[^/]*$", ""))).alias("canonical_path"),
        F.when(lost, "empty-window").alias("unattributed_reason"))


def tree_stats(t):
    return t.raw("pages").select(
        F.concat(F.lit("w"), "page_id").alias("workspace_id"), (F.col("page_id") % 100).cast("double").alias("credits"),
        F.lit(0.0).alias("measured_credits"), (F.col("page_id") % 7).alias("request_count"))


@query("j08_workspaces_with_spend", """SELECT workspace_id, CASE WHEN CAST(substr(workspace_id, 2) AS BIGINT) % 2 = 0 THEN credits ELSE 0 END AS credits, CASE WHEN CAST(substr(workspace_id, 2) AS BIGINT) % 2 = 0 THEN requests ELSE 0 END AS request_count FROM ws""", u=URL, ws=TREE["ws"])
def _(t):
    some = tree_stats(t).where(F.substring("workspace_id", 2, 20).cast("long") % 2 == 0)
    return SC.workspaces_with_spend(locations(t), some).select("workspace_id", "credits", "request_count")


@query("a10_project_tree", """SELECT folder, parent, workspaces, round(own_credits, 4) AS own_credits, CAST(own_requests AS BIGINT) AS own_requests, round(subtree_credits, 4) AS subtree_credits, CAST(subtree_requests AS BIGINT) AS subtree_requests, CAST(NULL AS VARCHAR) AS unattributed_reason FROM tree
UNION ALL SELECT NULL, NULL, count(*), sum(credits), CAST(sum(requests) AS BIGINT), sum(credits), CAST(sum(requests) AS BIGINT), reason FROM ws WHERE reason IS NOT NULL GROUP BY reason""", **TREE)
def _(t):
    return rounded(SC.project_tree(SC.workspaces_with_spend(locations(t), tree_stats(t))))


@query("f12_resolve_scope", """SELECT workspace_id FROM ws WHERE folder IN (SELECT f FROM a) OR EXISTS (SELECT 1 FROM a WHERE starts_with(ws.folder, a.f || '/'))""",
    u=URL, ws=TREE["ws"], a="SELECT DISTINCT folder AS f FROM ws WHERE CAST(substr(workspace_id, 2) AS BIGINT) % 10 = 3 AND folder IS NOT NULL")
def _(t):
    spots = locations(t)
    anchors = spots.where((F.substring("workspace_id", 2, 20).cast("long") % 10 == 3) & F.col("canonical_path").isNotNull())
    return SC.resolve_scope(spots, anchors.select(F.col("canonical_path").alias("anchor"))).select("workspace_id")


@query("j09_path_ancestors", """SELECT page_id, count(*) AS ancestors FROM (SELECT page_id, unnest(string_split(regexp_replace(raw, '/[^/]*$', ''), '/')) AS s FROM u) GROUP BY 1""", u=URL)
def _(t):
    raw = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return t.raw("pages").select("page_id", F.explode(SC.ancestors(F.regexp_replace(raw, "/[^/]*$", ""))).alias("a")).groupBy("page_id").agg(F.count(F.lit(1)).alias("ancestors"))


@query("d13_waste_report")
def _(t):
    return R.waste_report(corpus_of(t))


@query("d13_waste_findings")
def _(t):
    return R.waste_findings(corpus_of(t)).select("class", "credits", "confidence", "tier", F.size("evidence").alias("evidence"))


@query("p03_redact_evidence", """SELECT 'W9' AS class, 1 AS kept, 10 AS withheld FROM (SELECT count(*) FROM compaction)""")
def _(t):
    from ..operators.waste.detectors import compaction_overhead

    out = PR.redact_evidence(compaction_overhead(corpus_of(t)), 1)
    last = F.element_at("evidence", -1)
    return out.select("class", F.size(F.filter("evidence", lambda e: e["ref"] == "WITHHELD")).alias("kept"), last["count"].cast("int").alias("withheld"))


@query("d14_coverage_report", """SELECT unnest(['W13','W14','PD1','PD6','review-effort','incident-linkage','reviewer-concentration','chat-abandonment','developer-satisfaction','otel-tool-definitions','otel-cost-centres']) AS subject FROM (SELECT count(*) FROM lineitem)""")
def _(t):
    return R.coverage_report(corpus_of(t)).select("subject")


FIRST = """SELECT session_id, target_file_hash AS f, arg_min(target_start_line IS NULL AND target_end_line IS NULL, (ts, request_id, round_id, tool_call_id)) AS whole
  FROM calls WHERE name IN ('read_file', 'get_errors') AND target_file_hash IS NOT NULL GROUP BY 1, 2"""
PROBES = """SELECT 'w2-whole-file-first-reads' AS probe, avg(CASE WHEN whole THEN 1.0::DOUBLE ELSE 0 END) AS value, count(*) AS sample_size, 0.35::DOUBLE AS threshold, 30 AS minimum_sample FROM first_read
  UNION ALL SELECT 'w3-sub-cap-oversize', avg(CASE WHEN len(s) >= 10 AND s[len(s) // 2 + 1] > 0 AND result_chars > 3 * s[len(s) // 2 + 1] AND result_chars <= 16000 THEN 1.0::DOUBLE ELSE 0 END), count(*), 0.1, 50
    FROM tool_call JOIN (SELECT name, list(result_chars ORDER BY result_chars) FILTER (result_chars IS NOT NULL) AS s FROM tool_call GROUP BY 1) USING (name) WHERE result_chars IS NOT NULL
  UNION ALL SELECT 'w8-cross-developer-repeats', sum(CASE WHEN people > 1 THEN c * (n - 1) / n ELSE 0 END) / sum(c), count(*), 0.05, 200 FROM (SELECT count(DISTINCT asked_by) AS people, count(*) AS n, sum(credits) AS c FROM question GROUP BY question_hash)
  UNION ALL SELECT 'w11-unopened-references', avg(CASE WHEN o.f IS NULL THEN 1.0::DOUBLE ELSE 0 END), count(*), 0.4, 50 FROM content_reference c JOIN request r USING (request_id)
    LEFT JOIN first_read o ON o.session_id = r.session_id AND o.f = c.file_hash"""


@query("d15_residual_probes", """SELECT probe, round(value, 6) AS value, sample_size, threshold, minimum_sample, sample_size >= minimum_sample AS sufficient,
  sample_size >= minimum_sample AND value > threshold AS exceeded FROM probes""", first_read=FIRST, probes=PROBES)
def _(t):
    return rounded(R.residual_probes(corpus_of(t)), 6)


@query("v14_first_reads", """SELECT session_id, file_hash, arg_min(chars, seq) AS chars, arg_min(whole, seq) AS whole_file FROM (
  SELECT session_id, target_file_hash AS file_hash, coalesce(result_chars, 0) AS chars, target_start_line IS NULL AND target_end_line IS NULL AS whole, (ts, request_id, round_id, tool_call_id) AS seq
  FROM calls WHERE name IN ('read_file', 'get_errors') AND target_file_hash IS NOT NULL) GROUP BY 1, 2""")
def _(t):
    return R.first_reads(corpus_of(t))


@query("a16_spend_snapshot", """SELECT round(m, 4) AS month_to_date_credits, round(greatest(0, 150000 - m), 4) AS remaining_credits, round(m / 150000, 4) AS percent_used, round(greatest(0, m - 150000) * 0.01, 4) AS incremental_usd,
  (SELECT round(sum(price), 4) FROM priced) AS all_time_credits, (SELECT count(DISTINCT day) FROM priced) AS active_days, (SELECT CAST(floor(100 * sum(price) FILTER (is_measured) / sum(price) + 0.5) AS BIGINT) FROM priced) AS measured_percent,
  (SELECT string_agg(model, ',' ORDER BY c DESC) FROM (SELECT model, sum(price) AS c FROM priced GROUP BY 1)) AS top_models
FROM (SELECT sum(price) AS m FROM priced WHERE day BETWEEN DATE '1998-05-01' AND DATE '1998-05-31')""")
def _(t):
    out = R.spend_snapshot(corpus_of(t), "1998-05-17", 150_000.0)
    return rounded(out.select("month_to_date_credits", "remaining_credits", "percent_used", "incremental_usd", "all_time_credits", "active_days", "measured_percent", F.array_join("top_models", ",").alias("top_models")))


@query("a30_build_contribution", """SELECT strftime(day, '%Y-%m') AS period, round(sum(price), 4) AS total_credits, count(*) AS request_count, count(DISTINCT day) AS active_days, count(DISTINCT model) AS models, count(DISTINCT session_id) AS sessions FROM priced GROUP BY 1""")
def _(t):
    out = R.build_contribution(corpus_of(t))
    sessions = F.aggregate("session_lengths", F.lit(0).cast("long"), lambda a, s: a + s["sessions"])
    return rounded(out.select("period", "total_credits", "request_count", "active_days", F.size("by_model").cast("long").alias("models"), sessions.alias("sessions")))


@query("a38_monthly_report", """SELECT 'total' AS part, '' AS key, round(sum(price), 4) AS credits FROM priced WHERE strftime(day, '%Y-%m') = '1998-05'
UNION ALL SELECT 'model', model, round(sum(price), 4) FROM priced WHERE strftime(day, '%Y-%m') = '1998-05' GROUP BY 2
UNION ALL SELECT 'day', strftime(day, '%Y-%m-%d'), round(sum(price), 4) FROM priced WHERE strftime(day, '%Y-%m') = '1998-05' GROUP BY 2
UNION ALL SELECT 'budget', '', round(sum(price), 4) FROM priced WHERE strftime(day, '%Y-%m') = '1998-05'""")
def _(t):
    r = R.monthly_report(corpus_of(t), "1998-05", 150_000.0)
    part = lambda name, key, df, value="credits": df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), F.col(value).alias("credits"))
    return rounded(part("total", F.lit(""), r["totals"]).unionByName(part("model", F.col("model"), r["by_model"])).unionByName(part("day", F.col("day"), r["by_day"]))
                   .unionByName(part("budget", F.lit(""), r["budget"], "month_to_date_credits")))
