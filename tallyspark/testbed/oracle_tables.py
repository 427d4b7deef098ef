"""The same telemetry tables as `tables.py`, written for DuckDB."""

from __future__ import annotations

import re

CTES = {
    "request": """
  SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS session_id,
    epoch_ms(o_orderdate) AS ts, o_orderpriority AS model,
    CAST(floor(o_totalprice * (1 + (year(o_orderdate) - 1995) * CAST(0.1 AS DOUBLE))) AS BIGINT) AS prompt_tokens,
    o_orderkey % 500 AS output_tokens,
    CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice * (1 + (year(o_orderdate) - 1995) * CAST(0.1 AS DOUBLE))) / 1000.0
      * CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 8 WHEN '2' THEN 4 WHEN '3' THEN 2 WHEN '4' THEN 1 END
    END AS credits,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 8 + o_orderkey % 8 AS turn_index,
    'ws' || (o_custkey % 20) || '/chatSessions/' || o_custkey || '.jsonl' AS source_file,
    o_orderkey * 100 AS source_offset
  FROM orders""",
    "lines": """
  SELECT CAST(l_orderkey AS VARCHAR) AS request_id,
    l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT) AS call_id,
    'f' || (l_partkey % 50) AS file, * FROM lineitem""",
    "cost_centre": """
  SELECT p.request_id, p.label, p.part * 100.0 / w.whole AS percentage_of_prompt,
    CAST(floor(p.part * 100.0 / w.whole / 100.0 * r.prompt_tokens + 0.5) AS BIGINT) AS tokens
  FROM (SELECT request_id, ['Tool Definitions','Messages','Files','Tool Results','System Instructions'][l_linenumber % 5 + 1] AS label,
          sum(l_extendedprice) AS part FROM lines GROUP BY 1, 2) p
  JOIN (SELECT request_id, sum(l_extendedprice) AS whole FROM lines GROUP BY 1) w USING (request_id)
  JOIN request r USING (request_id)""",
    "tool_call": """
  SELECT request_id, call_id AS round_id, call_id AS tool_call_id,
    CASE WHEN l_partkey % 200 = 0 THEN 'mcp_vendor' || (l_suppkey % 5) || '_lookup'
         WHEN l_returnflag = 'N' THEN 'read_file' WHEN l_returnflag = 'A' THEN 'replace_string_in_file'
         ELSE 'run_in_terminal' END AS name,
    CAST(CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN 400000
         WHEN l_partkey % 31 = 0 THEN NULL ELSE l_quantity * 100 END AS BIGINT) AS result_chars,
    CASE WHEN l_returnflag <> 'R' THEN file END AS target_file_hash,
    CASE WHEN l_quantity >= 10 THEN l_linenumber * 10 END AS target_start_line,
    CASE WHEN l_quantity >= 10 THEN l_linenumber * 10 + 15 END AS target_end_line
  FROM lines""",
    "round": """
  SELECT request_id, call_id || '-' || rep AS round_id,
    CASE WHEN rep = 2 THEN CASE WHEN l_linenumber = 2 THEN '1-URGENT' ELSE '4-NOT SPECIFIED' END END AS model_id,
    CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity * 10 AS BIGINT) END AS thinking_tokens
  FROM (SELECT *, unnest(range(1, CAST(l_orderkey % 4 + 2 AS BIGINT))) AS rep FROM lines)""",
    "edit": """
  SELECT request_id, file AS file_hash, count(*) AS edit_count, bool_or(l_linestatus = 'F') AS done
  FROM lines WHERE l_returnflag = 'A' GROUP BY 1, 2""",
    "compaction": """
  SELECT l.request_id, l.call_id AS tool_call_round_id, r.model, l_linenumber AS num_rounds,
    l_linenumber * 1000 AS duration_ms, CASE WHEN l_linestatus = 'F' THEN 'Success' ELSE 'cancelled' END AS outcome,
    CAST(floor(l_extendedprice) AS BIGINT) AS context_length_before
  FROM lines l JOIN request r USING (request_id) WHERE l_quantity > 45""",
    "content_reference": """
  SELECT DISTINCT request_id, 'f' || (l_suppkey % 50) AS file_hash FROM lines""",
    "tracked_commit_file": """
  SELECT DISTINCT l.request_id AS sha, r.ts - l_partkey % 45 * 2592000000 AS ts, 'f' || (l_partkey % 45) AS path_hash
  FROM lines l JOIN request r USING (request_id)""",
    "commit_log": """
  SELECT CAST(o_orderkey AS VARCHAR) AS sha, CAST(o_custkey AS VARCHAR) AS author_id,
    epoch_ms(o_orderdate) AS ts,
    CASE WHEN o_orderkey % 11 = 0 THEN [CAST(o_orderkey - 1 AS VARCHAR), CAST(o_orderkey - 2 AS VARCHAR), CAST(o_orderkey - 7 AS VARCHAR)]
         ELSE [CAST(o_orderkey - 1 AS VARCHAR)] END AS parents,
    o_orderkey % 11 = 0 AS is_merge,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 1000 END AS pull_request,
    CASE WHEN o_orderkey % 37 = 0 THEN CAST(o_orderkey - 37 AS VARCHAR) END AS reverts_sha
  FROM orders""",
    "commit_file": """
  SELECT CAST(l_orderkey AS VARCHAR) AS sha, 'p' || l_partkey AS path_hash,
    CAST(sum(l_quantity) AS BIGINT) AS added,
    CAST(sum(floor(l_quantity * l_discount * 10)) AS BIGINT) AS deleted
  FROM lineitem GROUP BY 1, 2""",
    "survival": """
  SELECT l_linestatus AS arm,
    CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS duration,
    l_returnflag = 'R' AS event, l_quantity AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "panel": """
  SELECT CAST(o_custkey AS VARCHAR) AS unit,
    CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 365.0) AS BIGINT) AS period,
    avg(o_totalprice) AS outcome FROM orders GROUP BY 1, 2""",
    "cohort": """
  SELECT CAST(c_custkey AS VARCHAR) AS unit,
    CASE WHEN c_custkey % 5 <> 0 THEN 2 + c_custkey % 3 END AS treated_at FROM customer""",
    "roster": """
  SELECT CAST(c_custkey AS VARCHAR) AS unit, c_mktsegment AS team,
    greatest(c_acctbal, 0.0) AS pre_spend FROM customer""",
    "question": """
  SELECT event_type || '-' || CAST(floor(value / 5) AS BIGINT) AS question_hash,
    CAST(user_id AS VARCHAR) AS asked_by, value AS credits, epoch_ms(ts) AS ts FROM events""",
    # Derived money tables.
    "rate_card": """
  SELECT model, coalesce(sum(credits) FILTER (credits IS NOT NULL AND prompt_tokens > 0)
       / sum(prompt_tokens / 1000.0) FILTER (credits IS NOT NULL AND prompt_tokens > 0),
     (SELECT sum(credits) / sum(prompt_tokens / 1000.0) FROM request WHERE credits IS NOT NULL AND prompt_tokens > 0)) AS rate,
    count(*) FILTER (credits IS NOT NULL AND prompt_tokens > 0) AS sample_size
  FROM request GROUP BY model""",
    "priced": """
  SELECT q.*, coalesce(q.credits, q.prompt_tokens / 1000.0 * c.rate) AS price,
    q.credits IS NOT NULL AS is_measured, CAST(make_timestamp(q.ts * 1000) AS DATE) AS day
  FROM request q JOIN rate_card c USING (model)""",
    "per_token": """
  SELECT sum(price) / sum(prompt_tokens) AS cpt, sum(price) AS total_credits FROM priced""",
    "day_spend": """
  SELECT day, sum(price) AS credits, sum(prompt_tokens) AS prompt_tokens,
    sum(output_tokens) AS output_tokens, count(*) AS requests FROM priced GROUP BY day""",
    "cheapest": """
  SELECT min(rate) AS cheapest_rate, arg_min(model, rate) AS cheapest_model, max(rate) AS dearest_rate,
    count(*) AS measured_models FROM rate_card WHERE sample_size > 0 AND rate > 0""",
    "calls": """
  SELECT t.*, r.session_id, r.ts, r.ts AS request_ts FROM tool_call t JOIN request r USING (request_id)""",
    "rounds_per": "SELECT request_id, count(*) AS rounds, sum(thinking_tokens) AS thinking FROM round GROUP BY 1",
    "calls_per": "SELECT request_id, count(*) AS calls FROM tool_call GROUP BY 1",
    "edits_per": "SELECT request_id, sum(edit_count) AS edits, max(CASE WHEN done AND edit_count > 0 THEN 1 ELSE 0 END) AS finished FROM edit GROUP BY 1",
    "complexity": """
  SELECT r.request_id, CAST(coalesce(rounds, 0) * 1000 + coalesce(calls, 0) * 500 + 1500 * coalesce(edits, 0)
     + coalesce(thinking, 0) + output_tokens AS DOUBLE) / 500 AS score
  FROM request r LEFT JOIN rounds_per USING (request_id) LEFT JOIN calls_per USING (request_id)
    LEFT JOIN edits_per USING (request_id)""",
}
_ORDER = list(CTES)


def _needs(sql: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b{name}\b", sql)}


def with_tables(sql: str, **extra: str) -> str:
    """Prefix a query with the telemetry tables it names, in dependency order."""
    needed, queue = set(), [sql, *extra.values()]
    while queue:
        for name in _needs(queue.pop()) - needed:
            needed.add(name)
            queue.append(CTES[name])
    parts = [f'"{n}" AS ({CTES[n]})' if n == "round" else f"{n} AS ({CTES[n]})"
             for n in _ORDER if n in needed]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
