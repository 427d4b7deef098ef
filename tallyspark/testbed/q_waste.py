"""Registered queries: waste detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import duplication as DU
from ..operators import tools as TL
from ..operators.corpus import Corpus
from ..operators.waste import complexity as CX
from ..operators.waste import detectors as D
from .registry import query, rounded


def corpus_of(t) -> Corpus:
    return Corpus(
        request=t.request, cost_centre=t.cost_centre, tool_call=t.tool_call, round=t.round,
        edit=t.edit, compaction=t.compaction, content_reference=t.content_reference,
        commit_file=t.tracked_commit_file, question=t.question,
    )


def flat(finding):
    """A finding with its evidence references in order, for comparison."""
    refs = F.array_join(F.transform("evidence", lambda e: e["ref"]), ",")
    return rounded(
        finding.select("class", "credits", "confidence", "tier", refs.alias("evidence_refs")), 3
    )


def wanted(cls: str, tier: str, credits: str, n: str, half: float, effect: str, refs: str, source: str) -> str:
    """Oracle of a finding: confidence n/(n+half) damped by a clamped effect."""
    return f"""SELECT '{cls}' AS class, round(CAST({credits} AS DOUBLE), 3) AS credits,
  round(({n}) / (({n}) + {half}) * least(1, greatest(0, CAST({effect} AS DOUBLE))), 3) AS confidence, '{tier}' AS tier,
  {refs} AS evidence_refs FROM {source}"""


def top(select_ref: str, order: str, source: str, limit: int) -> str:
    return f"""(SELECT string_agg(ref, ',' ORDER BY rn) FROM (SELECT {select_ref} AS ref,
      row_number() OVER (ORDER BY {order}) AS rn FROM {source} ORDER BY rn LIMIT {limit}))"""


@query("j01_tool_call_join_request", """
SELECT session_id, name, count(*) AS calls, CAST(sum(result_chars) AS BIGINT) AS chars, max(ts) AS last_ts FROM calls GROUP BY 1, 2""")
def _(t):
    return corpus_of(t).calls.groupBy("session_id", "name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("result_chars").alias("chars"), F.max("ts").alias("last_ts")
    )


@query("a18_tool_server_roi", """
SELECT server, count(DISTINCT name) AS tool_count, count(*) AS invocations,
  round(count(*) / (SELECT count(*) FROM tool_call), 6) AS invocation_share,
  CASE WHEN count(*) / (SELECT count(*) FROM request) >= 0.25 THEN 'active'
       WHEN count(*) / (SELECT count(*) FROM request) >= 0.05 THEN 'marginal' ELSE 'unused-in-window' END AS verdict
FROM (SELECT name, CASE WHEN name LIKE 'mcp\\_%' ESCAPE '\\' THEN 'mcp:' || split_part(substr(name, 5), '_', 1) ELSE 'built-in' END AS server FROM tool_call)
GROUP BY server""")
def _(t):
    return rounded(TL.tool_server_roi(t.tool_call, t.request), 6)


@query("a19_complexity_score", "SELECT request_id, score FROM complexity")
def _(t):
    return CX.complexity_scores(corpus_of(t))


@query("a20_complexity_bands", """
SELECT s[CAST(floor(len(s) * 0.33::DOUBLE) AS BIGINT) + 1] AS low_ceiling, s[CAST(floor(len(s) * 0.67::DOUBLE) AS BIGINT) + 1] AS medium_ceiling,
  CAST(len(s) AS BIGINT) AS sample_size FROM (SELECT list(score ORDER BY score) AS s FROM complexity)""")
def _(t):
    return CX.complexity_bands(corpus_of(t))


DUPLICATION = """SELECT question_hash, count(DISTINCT asked_by) AS asked_by, count(*) AS occurrences, sum(credits) AS credits,
  sum(credits) * (count(*) - 1) / count(*) AS redundant FROM question GROUP BY question_hash"""


@query("a21_question_duplication", """
SELECT CASE WHEN asked_by >= 5 THEN question_hash END AS question_hash, asked_by, occurrences, round(credits, 9) AS credits,
  round(redundant, 9) AS redundant_credits, asked_by < 5 AS suppressed FROM q WHERE asked_by > 1""", q=DUPLICATION)
def _(t):
    return rounded(DU.detect_duplication(t.question), 9)


@query("a21_duplication_summary", """
SELECT count(*) AS questions_seen, count(*) FILTER (asked_by >= 5) AS clusters, count(*) FILTER (asked_by > 1 AND asked_by < 5) AS suppressed_clusters,
  round(sum(redundant) FILTER (asked_by > 1), 4) AS redundant_credits, (SELECT count(DISTINCT asked_by) FROM question) AS developers_seen,
  round(sum(redundant) FILTER (asked_by > 1) / sum(credits), 4) AS redundant_share FROM q""", q=DUPLICATION)
def _(t):
    return rounded(DU.duplication_summary(t.question))


@query("a22_cache_assessment", """
SELECT count(*) AS candidates, round(sum(redundant), 4) AS credits_saved,
  round(sum(redundant) / (SELECT sum(credits) FROM question), 4) AS share,
  sum(redundant) / (SELECT sum(credits) FROM question) >= 0.02 AS worth_building FROM q WHERE asked_by >= 5""", q=DUPLICATION)
def _(t):
    total = t.question.agg(F.sum("credits").alias("total_credits"))
    return rounded(DU.assess_cache(t.question, total))


@query("a23_prefix_stability", """
SELECT CAST(sum(n) AS BIGINT) AS requests, round(sum(n * lo / mean) / sum(n), 6) AS cacheable_share
FROM (SELECT conv_id, count(*) AS n, min(length(text)) AS lo, avg(length(text)) AS mean FROM conversations GROUP BY 1) WHERE n >= 2 AND mean > 0""")
def _(t):
    prompts = t.raw("conversations").select(
        F.col("conv_id").alias("session_id"), F.length("text").cast("long").alias("prompt_tokens")
    )
    return rounded(DU.prefix_stability(prompts), 6)


TOOLS = "SELECT name, count(*) AS calls, count(*) / (SELECT count(*) FROM request) AS rate FROM tool_call GROUP BY name"
W1 = """SELECT (SELECT sum(tokens) FROM cost_centre WHERE label = 'Tool Definitions') AS defined,
  (SELECT sum(tokens) FROM cost_centre) AS decomposed, count(*) AS tools, count(*) FILTER (rate < 0.05) AS rare,
  (SELECT count(*) FROM request) AS n, (SELECT cpt FROM per_token) AS cpt FROM tools"""


@query("d01_w1_tool_definition_tax", wanted(
    "W1", "A", "rare * defined / tools * cpt", "n", 30, "defined / decomposed / 0.25",
    "'ALL,APPORTIONMENT,' || " + top("name", "calls, name", "tools WHERE rate < 0.05", 12), "w1"),
    tools=TOOLS, w1=W1)
def _(t):
    return flat(D.tool_definition_tax(corpus_of(t)))


READS = """SELECT request_id, session_id, target_file_hash AS file_hash, ts, coalesce(result_chars, 0) AS chars,
  coalesce(target_start_line, 0) AS s, coalesce(target_end_line, 9007199254740991) AS e,
  row_number() OVER (ORDER BY ts, request_id, round_id, tool_call_id) AS seq
  FROM calls WHERE name IN ('read_file', 'get_errors') AND target_file_hash IS NOT NULL"""
EDIT_TIMES = "SELECT DISTINCT session_id, file_hash, ts FROM edit JOIN request USING (request_id)"
REREADS = """SELECT a.request_id, a.session_id, a.file_hash, a.seq, any_value(a.chars) AS chars,
  bool_or(b.ts >= coalesce((SELECT max(x.ts) FROM edit_times x WHERE x.session_id = a.session_id AND x.file_hash = a.file_hash AND x.ts <= a.ts), -1e18)) AS duplicate
  FROM reads a JOIN reads b ON a.session_id = b.session_id AND a.file_hash = b.file_hash AND b.seq < a.seq AND b.s <= a.e AND a.s <= b.e
  GROUP BY 1, 2, 3, 4"""


@query("j04_rereads", """
SELECT request_id, session_id, file_hash, count(*) AS rereads, count(*) FILTER (duplicate) AS duplicates,
  CAST(sum(chars) AS BIGINT) AS chars FROM rereads GROUP BY 1, 2, 3""",
    reads=READS, edit_times=EDIT_TIMES, rereads=REREADS)
def _(t):
    return corpus_of(t).rereads.groupBy("request_id", "session_id", "file_hash").agg(
        F.count(F.lit(1)).alias("rereads"), F.count(F.when(F.col("duplicate"), 1)).alias("duplicates"),
        F.sum("chars").alias("chars"),
    )


@query("d02_w2_duplicate_retrieval", wanted(
    "W2", "B", "floor(chars / 4 + 0.5) * cpt", "reads", 50, "dup / reads / 0.3",
    "'ALL,REFRESHED,' || " + top("file_hash", "sum(chars) DESC, session_id, file_hash",
                                 "rereads WHERE duplicate GROUP BY session_id, file_hash", 10), "w2"),
    reads=READS, edit_times=EDIT_TIMES, rereads=REREADS,
    w2="""SELECT count(*) FILTER (duplicate) AS dup, sum(chars) FILTER (duplicate) AS chars,
      (SELECT count(*) FROM reads) AS reads, (SELECT cpt FROM per_token) AS cpt FROM rereads""")
def _(t):
    return flat(D.duplicate_retrieval(corpus_of(t)))


OVERSIZED = """SELECT t.*, threshold FROM tool_call t JOIN (
    SELECT name, greatest(16000, 20 * s[len(s) // 2 + 1]) AS threshold FROM (
      SELECT name, list(result_chars ORDER BY result_chars) FILTER (result_chars IS NOT NULL) AS s FROM tool_call GROUP BY name) WHERE len(s) >= 10) USING (name)
  WHERE result_chars > threshold"""


@query("d03_w3_oversized_payloads", wanted(
    "W3", "B", "floor(chars / 4 + 0.5) * cpt", "n", 200, "offenders / (n * 0.01)",
    "'ALL,' || " + top("request_id", "result_chars DESC, request_id, tool_call_id", "oversized", 10), "w3"),
    oversized=OVERSIZED,
    w3="""SELECT count(*) AS offenders, sum(result_chars - threshold) AS chars,
      (SELECT count(result_chars) FROM tool_call) AS n, (SELECT cpt FROM per_token) AS cpt FROM oversized""")
def _(t):
    return flat(D.oversized_payloads(corpus_of(t)))


STALE = """SELECT session_id, count(*) AS stale, sum(prompt_tokens - baseline) AS excess FROM (
    SELECT *, avg(prompt_tokens) FILTER (turn <= 3) OVER (PARTITION BY session_id) AS baseline FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, ts, request_id) AS turn FROM request))
  WHERE turn > 8 AND prompt_tokens > baseline GROUP BY 1"""


@query("d04_w4_session_staleness", wanted(
    "W4", "C", "excess * cpt", "stale", 40, "offenders / sessions",
    "'ALL,' || " + top("session_id", "round(-excess, 4), session_id", "stale_sessions", 10), "w4"),
    stale_sessions=STALE,
    w4="""SELECT count(*) AS offenders, sum(stale) AS stale, sum(excess) AS excess,
      (SELECT count(DISTINCT session_id) FROM request) AS sessions, (SELECT cpt FROM per_token) AS cpt FROM stale_sessions""")
def _(t):
    return flat(D.session_staleness(corpus_of(t)))


OVER = """SELECT p.model, price - prompt_tokens / 1000.0 * cheapest_rate AS saving FROM priced p JOIN complexity USING (request_id)
    JOIN rate_card c ON c.model = p.model, cheapest,
    (SELECT s[CAST(floor(len(s) * 0.33::DOUBLE) AS BIGINT) + 1] AS ceiling FROM (SELECT list(score ORDER BY score) AS s FROM complexity))
  WHERE sample_size > 0 AND c.rate / cheapest_rate >= 3 AND score <= ceiling AND price > prompt_tokens / 1000.0 * cheapest_rate"""


@query("d05_w5_model_over_selection", wanted(
    "W5", "A", "saving", "flagged", 30, "dearest_rate / cheapest_rate / 10",
    "cheapest_model || ',' || " + top("model", "sum(saving) DESC, model", "over_selected GROUP BY model", 8), "w5"),
    over_selected=OVER,
    w5="SELECT count(*) AS flagged, sum(saving) AS saving, any_value(cheapest_model) AS cheapest_model, any_value(cheapest_rate) AS cheapest_rate, any_value(dearest_rate) AS dearest_rate FROM over_selected, cheapest")
def _(t):
    return flat(D.model_over_selection(corpus_of(t)))


RUNAWAY = """SELECT p.request_id, coalesce(rounds, 0) AS depth, price FROM priced p LEFT JOIN rounds_per USING (request_id)
    LEFT JOIN edits_per USING (request_id),
    (SELECT greatest(10, s[CAST(ceil(len(s) * 0.9::DOUBLE) AS BIGINT)]) AS threshold FROM (
      SELECT list(coalesce(rounds, 0) ORDER BY coalesce(rounds, 0)) AS s FROM request LEFT JOIN rounds_per USING (request_id)))
  WHERE coalesce(rounds, 0) >= threshold AND coalesce(finished, 0) = 0"""


@query("d06_w6_runaway_loops", wanted(
    "W6", "B", "price", "n", 15, "0.7",
    "'ALL,' || " + top("request_id", "round(-price, 6), request_id", "runaway", 10), "w6"),
    runaway=RUNAWAY, w6="SELECT count(*) AS n, sum(price) AS price FROM runaway")
def _(t):
    return flat(D.runaway_loops(corpus_of(t)))


JUDGED = """SELECT e.request_id, e.file_hash, CASE WHEN r.ts > (SELECT greatest(max(ts), (SELECT max(ts) FROM tracked_commit_file)) FROM request) - 7200000 THEN 'recent'
    WHEN latest IS NULL THEN 'untracked' WHEN latest >= r.ts THEN 'survived' ELSE 'lost' END AS verdict
  FROM edit e JOIN request r USING (request_id)
  LEFT JOIN (SELECT path_hash AS file_hash, max(ts) AS latest FROM tracked_commit_file GROUP BY 1) USING (file_hash)"""
JUDGED_REQUESTS = """SELECT request_id, count(*) AS files, bool_or(verdict = 'survived') AS survived FROM judged
  WHERE verdict IN ('survived', 'lost') GROUP BY 1"""


@query("j05_survival_coverage", """
SELECT (SELECT count(*) FROM judged_requests) AS judged_requests, count(*) FILTER (verdict IN ('survived', 'lost')) AS judged_files,
  count(*) FILTER (verdict = 'untracked') AS untracked_files, count(*) FILTER (verdict = 'recent') AS too_recent,
  round(count(*) FILTER (verdict IN ('survived', 'lost')) / count(*) FILTER (verdict <> 'recent'), 6) AS coverage,
  (SELECT count(*) FROM judged_requests) >= 20 AND count(*) FILTER (verdict IN ('survived', 'lost')) / count(*) FILTER (verdict <> 'recent') >= 0.5 AS sufficient
FROM judged""", judged=JUDGED, judged_requests=JUDGED_REQUESTS)
def _(t):
    return rounded(D.survival_coverage(corpus_of(t)), 6)


@query("d07_w7_abandoned_work", wanted(
    "W7", "C", "price", "n", 40, "lost_n / n / 0.5",
    "'ALL,UNTRACKED,SETTLING,' || " + top("request_id", "round(-price, 6), request_id", "lost", 10), "w7"),
    judged=JUDGED, judged_requests=JUDGED_REQUESTS,
    lost="SELECT request_id, price FROM judged_requests JOIN priced USING (request_id) WHERE NOT survived",
    w7="SELECT * FROM (SELECT count(*) AS lost_n, sum(price) AS price, (SELECT count(*) FROM judged_requests) AS n FROM lost) WHERE lost_n > 0")
def _(t):
    return flat(D.abandoned_work(corpus_of(t)))


@query("d08_w8_cross_developer_duplication", wanted(
    "W8", "A", "shown", "questions", 500, "redundant / credits / 0.1",
    "'ALL,SUPPRESSED,' || " + top("question_hash", "round(-redundant, 6), question_hash", "q WHERE asked_by >= 5", 10), "w8"),
    q=DUPLICATION,
    w8="""SELECT sum(redundant) FILTER (asked_by >= 5) AS shown, sum(redundant) FILTER (asked_by > 1) AS redundant,
      sum(credits) AS credits, count(*) AS questions FROM q""")
def _(t):
    return flat(D.cross_developer_duplication(corpus_of(t)))


@query("d09_w9_compaction", wanted(
    "W9", "C", "tokens * cpt", "n", 10, "0.9",
    "'ALL,FAILED,' || " + top("request_id", "context_length_before DESC, request_id, tool_call_round_id", "compaction", 8), "w9"),
    w9="SELECT count(*) AS n, sum(context_length_before) AS tokens, (SELECT cpt FROM per_token) AS cpt FROM compaction")
def _(t):
    return flat(D.compaction_overhead(corpus_of(t)))


@query("d09_compaction_wait", """
SELECT n AS events, round(total / 3600000, 6) AS wait_hours, CAST(s[n // 2 + 1] AS BIGINT) AS median_wait_ms, failed
FROM (SELECT count(*) AS n, sum(duration_ms) AS total, list(duration_ms ORDER BY duration_ms) AS s,
  count(*) FILTER (outcome NOT ILIKE '%success%') AS failed FROM compaction)""")
def _(t):
    from ..functions.quantiles import med_upper, rank_pick
    from ..session import attach

    events = t.compaction
    whole = events.agg(
        F.count(F.lit(1)).alias("events"), (F.sum("duration_ms") / 3_600_000).alias("wait_hours"),
        F.count(F.when(~F.lower("outcome").contains("success"), 1)).alias("failed"),
    )
    return rounded(attach(whole, rank_pick(events, "duration_ms", {"median_wait_ms": med_upper})), 6)


SERIES = """SELECT request_id, ts, tokens, row_number() OVER (ORDER BY ts, request_id) AS place, count(*) OVER () AS n
  FROM request JOIN (SELECT request_id, sum(tokens) AS tokens FROM cost_centre WHERE label = 'System Instructions' GROUP BY 1) USING (request_id)"""
SPLIT = """SELECT list(tokens ORDER BY tokens) FILTER (place <= greatest(20, floor(n * 0.25))) AS early,
  list(tokens ORDER BY tokens) FILTER (place > greatest(20, floor(n * 0.25))) AS late FROM series"""


@query("d10_w10_instruction_bloat", wanted(
    "W10", "C", "excess * cpt", "n", 200, "(current - baseline) / baseline", "'BASELINE,CURRENT,ALL'", "w10"),
    series=SERIES, split=SPLIT,
    medians="SELECT early[len(early) // 2 + 1] AS baseline, late[len(late) // 2 + 1] AS current FROM split",
    w10="""SELECT any_value(n) AS n, any_value(baseline) AS baseline, any_value(current) AS current,
      sum(greatest(0, tokens - baseline)) FILTER (place > greatest(20, floor(n * 0.25))) AS excess,
      (SELECT cpt FROM per_token) AS cpt FROM series, medians""")
def _(t):
    return flat(D.instruction_bloat(corpus_of(t)))


REFS = """SELECT c.request_id, c.file_hash, r.session_id,
    CASE WHEN f.tokens > 0 THEN f.tokens / count(*) OVER (PARTITION BY c.request_id) END AS share,
    EXISTS (SELECT 1 FROM opened o WHERE o.session_id = r.session_id AND o.file_hash = c.file_hash) AS opened
  FROM content_reference c JOIN request r USING (request_id)
  LEFT JOIN (SELECT request_id, sum(tokens) AS tokens FROM cost_centre WHERE label = 'Files' GROUP BY 1) f USING (request_id)"""
OPENED = "SELECT DISTINCT session_id, target_file_hash AS file_hash FROM calls WHERE name IN ('read_file', 'get_errors') AND target_file_hash IS NOT NULL"


@query("j06_references_never_opened", """
SELECT request_id, count(*) AS refs, count(*) FILTER (NOT opened) AS unopened FROM refs GROUP BY 1""", opened=OPENED, refs=REFS)
def _(t):
    return D.judged_references(corpus_of(t)).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("refs"), F.count(F.when(~F.col("opened"), 1)).alias("unopened")
    )


@query("d11_w11_reference_leakage", wanted(
    "W11", "B", "tokens * cpt", "judged", 200, "unopened / judged / 0.6",
    "'ALL,UNPRICEABLE,' || " + top("session_id", "round(-sum(share), 4), session_id",
        "refs WHERE share IS NOT NULL AND NOT opened GROUP BY session_id", 10), "w11"),
    opened=OPENED, refs=REFS,
    w11="""SELECT count(share) AS judged, count(*) FILTER (share IS NOT NULL AND NOT opened) AS unopened,
      sum(share) FILTER (NOT opened) AS tokens, (SELECT cpt FROM per_token) AS cpt FROM refs""")
def _(t):
    return flat(D.reference_leakage(corpus_of(t)))


DRIFT = """SELECT c.request_id, c.tool_call_round_id, context_length_before / 1000.0 * (rate - cheapest_rate) AS cost,
    sample_size > 0 AS judged, sample_size > 0 AND rate > 2 * cheapest_rate AS dear FROM compaction c LEFT JOIN rate_card USING (model), cheapest"""


@query("d12_w12_utility_model_drift", wanted(
    "W12", "A", "cost", "judged", 20, "drifted / judged / 0.5",
    "'ALL,SUB-STEPS,UNPRICEABLE,' || " + top("request_id", "round(-cost, 6), request_id, tool_call_round_id", "drift WHERE dear", 10), "w12"),
    drift=DRIFT, w12="SELECT count(*) FILTER (judged) AS judged, count(*) FILTER (dear) AS drifted, sum(cost) FILTER (dear) AS cost FROM drift")
def _(t):
    return flat(D.utility_model_drift(corpus_of(t)))


@query("j07_substep_rounds", """
SELECT o.model_id, count(*) AS rounds FROM "round" o JOIN request r USING (request_id) WHERE o.model_id <> r.model GROUP BY 1""")
def _(t):
    return D.substep_rounds(corpus_of(t)).groupBy("model_id").agg(F.count(F.lit(1)).alias("rounds"))
