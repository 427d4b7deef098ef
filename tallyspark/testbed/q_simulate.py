"""Registered queries: counterfactual simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import simulate as X
from .q_waste import EDIT_TIMES, READS, REREADS, corpus_of
from .registry import query, rounded

POLICY = X.Policy(
    route=(
        X.Route("4-NOT SPECIFIED", complexity="low"),
        X.Route("3-MEDIUM", complexity="medium", max_rounds=12),
    ),
    allow_mcp=("vendor1",),
    deny_tools=("run_in_*",),
    max_result_tokens=1000,
    max_rounds=12,
    nudge_after_turns=8,
    dedupe_reads=True,
)

SIM = dict(
    banded="""SELECT r.request_id, r.model, coalesce(rounds, 0) AS rounds,
      CASE WHEN score <= s[CAST(floor(len(s) * 0.33::DOUBLE) AS BIGINT) + 1] THEN 'low'
           WHEN score <= s[CAST(floor(len(s) * 0.67::DOUBLE) AS BIGINT) + 1] THEN 'medium' ELSE 'high' END AS band
      FROM request r JOIN complexity USING (request_id) LEFT JOIN rounds_per USING (request_id), (SELECT list(score ORDER BY score) AS s FROM complexity)""",
    regret="""SELECT t AS target, b AS band, count(*) FILTER (band = b AND model = t) AS target_samples,
      count(*) FILTER (band = b AND model <> t) AS origin_samples,
      avg(rounds) FILTER (band = b AND model = t) AS target_rounds, avg(rounds) FILTER (band = b AND model <> t) AS origin_rounds
      FROM banded, (VALUES ('4-NOT SPECIFIED', 'low'), ('3-MEDIUM', 'medium')) v(t, b) GROUP BY 1, 2""",
    routing="""SELECT request_id, 'model-routing' AS lever, 'A' AS tier,
      1 + CASE WHEN target_samples >= 10 AND origin_samples >= 10 AND origin_rounds > 0 THEN greatest(0, target_rounds / origin_rounds - 1) ELSE 0 END AS token_scale,
      t.rate / f.rate AS rate_scale
      FROM (SELECT *, CASE WHEN band = 'low' THEN '4-NOT SPECIFIED' WHEN band = 'medium' AND rounds <= 12 THEN '3-MEDIUM' END AS target FROM banded) b
      JOIN rate_card f ON f.model = b.model JOIN rate_card t ON t.model = b.target JOIN regret g ON g.target = b.target
      WHERE b.target <> b.model AND t.sample_size > 0 AND f.rate > 0""",
    trimmed="SELECT name, count(*) AS calls, name LIKE 'run_in_%' OR (name LIKE 'mcp%' AND name NOT LIKE 'mcp_vendor1_%') AS removed FROM tool_call GROUP BY name",
    trim="""SELECT request_id, 'tool-trim', 'A', greatest(0, (prompt_tokens - tokens * share) / prompt_tokens), 1.0
      FROM request JOIN (SELECT request_id, sum(tokens) AS tokens FROM cost_centre WHERE label = 'Tool Definitions' GROUP BY 1) USING (request_id),
        (SELECT count(*) FILTER (removed) / count(*) AS share FROM trimmed) WHERE prompt_tokens > 0 AND tokens * share > 0""",
    results="SELECT request_id, sum(tokens) AS ceiling FROM cost_centre WHERE label = 'Tool Results' GROUP BY 1",
    payload="""SELECT request_id, 'payload-cap', 'B', greatest(0, (prompt_tokens - least(floor(chars / 4 + 0.5), ceiling)) / prompt_tokens), 1.0
      FROM request JOIN (SELECT request_id, sum(result_chars - 4000) AS chars FROM tool_call WHERE result_chars > 4000 GROUP BY 1) USING (request_id)
      JOIN results USING (request_id) WHERE least(floor(chars / 4 + 0.5), ceiling) > 0""",
    loops="SELECT request_id, 'loop-cap', 'B', 12 / rounds, 1.0 FROM rounds_per WHERE rounds > 12",
    hygiene="""SELECT request_id, 'session-hygiene', 'C', baseline / prompt_tokens, 1.0 FROM (
      SELECT *, avg(prompt_tokens) FILTER (turn <= 3) OVER (PARTITION BY session_id) AS baseline FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, ts, request_id) AS turn FROM request))
      WHERE turn > 8 AND prompt_tokens > baseline""",
    reads=READS, edit_times=EDIT_TIMES, rereads=REREADS,
    dedupe="""SELECT request_id, 'dedupe-reads', 'B', greatest(0, (prompt_tokens - least(floor(chars / 4 + 0.5), ceiling)) / prompt_tokens), 1.0
      FROM request JOIN (SELECT request_id, sum(chars) AS chars FROM rereads WHERE duplicate GROUP BY 1) USING (request_id)
      JOIN results USING (request_id) WHERE chars > 0 AND least(floor(chars / 4 + 0.5), ceiling) > 0""",
    changes="SELECT * FROM routing UNION ALL SELECT * FROM trim UNION ALL SELECT * FROM payload UNION ALL SELECT * FROM loops UNION ALL SELECT * FROM hygiene UNION ALL SELECT * FROM dedupe",
    damped="""SELECT c.*, price, token_scale * rate_scale AS net,
      1 - (1 - token_scale * rate_scale) * CASE tier WHEN 'A' THEN 0.7 WHEN 'B' THEN 0.5 ELSE 0.1 END AS low,
      1 - (1 - token_scale * rate_scale) * CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.9 ELSE 0.5 END AS high
      FROM changes c JOIN priced USING (request_id)""",
    by_lever="""SELECT lever, tier, count(*) AS n, sum(price * (1 - net)) AS t, sum(price * (1 - low)) AS l, sum(price * (1 - high)) AS h
      FROM damped GROUP BY 1, 2""",
    combined="""SELECT request_id, any_value(price) AS price, product(net) AS net, product(low) AS low, product(high) AS high FROM damped GROUP BY 1""",
)
_names = list(SIM)


def upto(name: str) -> dict[str, str]:
    return {n: SIM[n] for n in _names[: _names.index(name) + 1]}


def lever_query(name: str, lever: str, cte: str, build):
    sql = f"""SELECT request_id, '{lever}' AS lever, round(token_scale, 9) AS token_scale, round(rate_scale, 9)::DOUBLE AS rate_scale
      FROM (SELECT * FROM {cte}) x(request_id, lever, tier, token_scale, rate_scale)"""

    @query(name, sql, **upto(cte))
    def _(t):
        out = build(corpus_of(t), POLICY).select("request_id", "lever", "token_scale", "rate_scale")
        return rounded(out, 9)


lever_query("c01_lever_model_routing", "model-routing", "routing", X.model_routing)
lever_query("c03_lever_tool_trim", "tool-trim", "trim", X.tool_trim)
lever_query("c04_lever_payload_cap", "payload-cap", "payload", X.payload_cap)
lever_query("c05_lever_loop_cap", "loop-cap", "loops", X.loop_cap)
lever_query("c06_lever_session_hygiene", "session-hygiene", "hygiene", X.session_hygiene)
lever_query("c07_lever_dedupe_reads", "dedupe-reads", "dedupe", X.dedupe_reads)


@query("c02_measure_regret", """
SELECT target, band, target_samples, origin_samples, round(target_rounds, 6) AS target_rounds, round(origin_rounds, 6) AS origin_rounds,
  round(greatest(0, target_rounds / origin_rounds - 1), 6) AS regret FROM regret""", **upto("regret"))
def _(t):
    return rounded(X.measure_regret(corpus_of(t), POLICY), 6)


@query("c05_loop_cap_risk", """
SELECT count(*) AS capped, count(*) FILTER (finished = 1) AS capped_with_edit, max(rounds) AS deepest
FROM rounds_per LEFT JOIN edits_per USING (request_id) WHERE rounds > 12""")
def _(t):
    return X.loop_cap_risk(corpus_of(t), POLICY)


@query("c08_replay", """
SELECT request_id, round(price, 7) AS price, round(net, 9) AS scale_theoretical, round(low, 9) AS scale_low,
  round(high, 9) AS scale_high FROM combined""", **upto("combined"))
def _(t):
    corpus = corpus_of(t)
    out = X.replay(corpus, X.plan_changes(corpus, POLICY))
    return rounded(out.withColumn("price", F.round("price", 7)).drop(
        "saved_theoretical", "saved_low", "saved_high"), 9)


@query("c09_lever_results", """
SELECT lever, tier, n AS requests_affected, round(t, 3) AS saved_theoretical, round(l, 3) AS saved_low, round(h, 3) AS saved_high,
  round(t / total_credits, 3) AS share_of_baseline FROM by_lever, per_token""", **upto("by_lever"))
def _(t):
    corpus = corpus_of(t)
    return rounded(X.lever_results(corpus, X.plan_changes(corpus, POLICY)), 3)


@query("c09_simulation_report", """
SELECT round(total_credits, 3) AS baseline_credits, (SELECT count(*) FROM request) AS requests, requests_affected,
  round(t, 3) AS saved_theoretical, round(l, 3) AS saved_low, round(h, 3) AS saved_high,
  round(t / total_credits, 3) AS reduction_theoretical, round(l / total_credits, 3) AS reduction_low, round(h / total_credits, 3) AS reduction_high,
  round(naive, 3) AS naive_sum, round(naive - t, 3) AS overlap,
  round((1 - rest) * total_credits, 3) AS multiplicative_estimate
FROM per_token, (SELECT count(*) AS requests_affected, sum(price * (1 - net)) AS t, sum(price * (1 - low)) AS l, sum(price * (1 - high)) AS h FROM combined),
  (SELECT sum(t) AS naive, product(1 - t / total_credits) AS rest FROM by_lever, per_token)""", **upto("combined"))
def _(t):
    return rounded(X.simulation_report(corpus_of(t), POLICY), 3)


@query("c10_contract_ceiling", """
SELECT c_custkey, round(included, 4) AS included_credits, round(projected, 4) AS projected_monthly_credits, round(over, 4) AS overage_credits,
  round(CASE WHEN over > 0 THEN over / projected END, 4) AS reduction_that_eliminates_overage,
  round(projected * 0.2, 4) AS saved_credits, round(least(projected * 0.2, over), 4) AS cash_credits,
  round(greatest(0, projected * 0.2 - least(projected * 0.2, over)), 4) AS unused_allowance_credits,
  projected * 0.2::DOUBLE > over AS exceeds_ceiling, round(CASE WHEN over > 0 THEN least(projected * 0.2, over) / over ELSE 0 END, 4) AS share_of_max_cash_saving
FROM (SELECT *, greatest(0, projected - included) AS over FROM (
  SELECT c_custkey, 3900.0::DOUBLE * seats AS included, greatest(c_acctbal, 0) * seats AS projected FROM (SELECT *, 1 + c_custkey % 40 AS seats FROM customer)))""")
def _(t):
    seats = t.raw("customer").select(
        "c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("projected_per_seat"),
        F.lit("enterprise").alias("plan"), (1 + F.col("c_custkey") % 40).alias("seats"),
    )
    out = X.split_at_ceiling(X.contract_ceiling(seats), F.lit(0.2))
    return rounded(out.drop("projected_per_seat", "plan", "seats", "reduction"))


@query("v12_solve_tool_surface", """
SELECT name, calls, sum(calls) OVER (ORDER BY calls, name) <= floor((sum(calls) OVER ()) * (1 - 0.99::DOUBLE)) AS remove
FROM (SELECT name, count(*) AS calls FROM tool_call GROUP BY 1)""")
def _(t):
    return X.solve_tool_surface(corpus_of(t))


LOOP_CAP = """SELECT cap, caught, unproductive FROM (
  SELECT c.cap, count(*) AS caught, count(*) FILTER (finished IS DISTINCT FROM 1) AS unproductive
  FROM (SELECT DISTINCT rounds - 1 AS cap FROM rounds_per WHERE rounds - 1 >= 10) c
  JOIN (SELECT r.request_id, rounds, finished FROM rounds_per r LEFT JOIN edits_per USING (request_id)) d ON d.rounds > c.cap GROUP BY 1)
  WHERE unproductive / caught >= 0.5 ORDER BY unproductive DESC, cap LIMIT 1"""


@query("v13_solve_loop_cap", "SELECT max(cap) AS cap, max(caught) AS caught, max(unproductive) AS unproductive_caught FROM loop_cap", loop_cap=LOOP_CAP)
def _(t):
    return X.solve_loop_cap(corpus_of(t))


@query("c11_recommend_policy", """
SELECT (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name, sum(calls) OVER (ORDER BY calls, name) <= floor((sum(calls) OVER ()) * (1 - 0.99::DOUBLE)) AS gone
    FROM (SELECT name, count(*) AS calls FROM tool_call GROUP BY 1)) WHERE gone) AS deny_tools,
  (SELECT cap FROM loop_cap) AS max_rounds, (SELECT cheapest_model FROM cheapest) AS low_complexity_to,
  (SELECT CAST(greatest(1000, floor(s[CAST(ceil(len(s) * 0.95::DOUBLE) AS BIGINT)] / 4 + 0.5)) AS BIGINT) FROM (SELECT list(result_chars ORDER BY result_chars) FILTER (result_chars IS NOT NULL) AS s FROM tool_call)) AS max_result_tokens,
  (SELECT CAST(greatest(8, s[CAST(ceil(len(s) * 0.95::DOUBLE) AS BIGINT)]) AS BIGINT) FROM (SELECT list(n ORDER BY n) AS s FROM (SELECT count(DISTINCT name) AS n FROM tool_call GROUP BY request_id))) AS virtual_tools_threshold,
  (SELECT max(result_chars) > 16000 FROM tool_call) AS compress_terminal_output, 8 AS nudge_after_turns, true AS dedupe_reads""", loop_cap=LOOP_CAP)
def _(t):
    out = X.recommend_policy(corpus_of(t))
    return out.withColumn("deny_tools", F.nullif(F.array_join("deny_tools", ","), F.lit("")))


@query("c12_virtual_tool_threshold", """
SELECT CAST(greatest(8, s[CAST(ceil(len(s) * 0.95::DOUBLE) AS BIGINT)]) AS BIGINT) AS virtual_tools_threshold
FROM (SELECT list(n ORDER BY n) AS s FROM (SELECT count(DISTINCT name) AS n FROM tool_call GROUP BY request_id))""")
def _(t):
    return X.virtual_tool_threshold(corpus_of(t))
