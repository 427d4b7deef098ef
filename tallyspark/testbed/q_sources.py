"""Registered queries: sources, scalar functions and storage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpoint_dir, materialise, written
from ..sources import files as FI
from ..sources import git as G
from ..sources import journals as J
from ..sources import normalise as N
from ..sources import store as ST
from ..sources import tables as TS
from .registry import query, rounded

SALT = "pepper"


def journal_lines(t):
    """Per customer: a snapshot, one append per order, and a late set on the first request."""
    # Orders are spread over the cores while they are narrow, not as lines.
    o = t.raw("orders").repartition(t.spark.sparkContext.defaultParallelism, "o_orderkey")
    path = F.concat(F.lit("/home/u/workspaceStorage/ws"), F.col("o_custkey") % 20, F.lit("/chatSessions/"), F.col("o_custkey"), F.lit(".jsonl"))
    key = F.col("o_orderkey")
    meta = F.struct(F.when(key % 9 != 0, key * 10).alias("promptTokens"), (key % 500).alias("outputTokens"), F.array(
        F.struct(F.concat(F.lit("r"), key).alias("id"), F.lit(5).alias("timestamp"), F.struct((key % 7).alias("tokens")).alias("thinking"), F.array(
            F.struct(F.lit("c1").alias("id"), F.lit("read_file").alias("name"), F.to_json(F.struct(F.concat(F.lit("/Src/F"), key % 50, F.lit(".py")).alias("filePath"), F.lit(3).alias("startLine"))).alias("arguments"))).alias("toolCalls"))).alias("toolCallRounds"),
        F.create_map(F.lit("c1"), F.struct(F.lit("skip").alias("type"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("parts"))).alias("toolCallResults"),
        F.array(F.struct(F.lit("x").alias("toolCallRoundId"), F.lit("m").alias("model"), F.lit(2).alias("numRounds"), F.lit(900).alias("durationMs"), F.lit("success").alias("outcome"), (key * 3).alias("contextLengthBefore"))).alias("summaries"))
    file = F.struct(F.concat(F.lit("/Src/F"), key % 50, F.lit(".py")).alias("fsPath"))
    request = F.struct(key.cast("string").alias("requestId"), t_ms(F.col("o_orderdate")).alias("timestamp"), F.col("o_orderpriority").alias("modelId"), F.struct(meta.alias("metadata")).alias("result"),
        F.array(F.struct(F.lit("p").alias("category"), F.lit("Files").alias("label"), F.lit(6.25).alias("percentageOfPrompt")), F.struct(F.lit("p").alias("category"), F.lit("New Label").alias("label"), F.lit(30).alias("percentageOfPrompt"))).alias("promptTokenDetails"),
        F.array(F.struct(F.lit("textEditGroup").alias("kind"), file.alias("uri"), F.array(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.lit("b").alias("text")))).alias("edits"), (key % 2 == 0).alias("done"))).alias("response"),
        F.array(F.struct(file.alias("reference"))).alias("contentReferences"))
    env = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    append = o.select(path.alias("path"), (key * 10 + 10).alias("offset"), env(kind=F.lit(2), k=F.array(F.lit("requests")), v=F.array(request)).alias("line"))
    files = t.raw("orders").select(path.alias("path"), "o_custkey").distinct()
    line = lambda offset, text: F.struct(F.lit(offset).cast("long").alias("offset"), text.alias("line"))
    others = F.array(
        line(0, F.concat(F.lit('{"kind":0,"v":{"sessionId":"s'), "o_custkey", F.lit('","requests":[]}}'))),
        line(1 << 40, F.lit('{"kind":1,"k":["requests",0,"copilotCredits"],"v":6.25}')),
        line((1 << 40) + 1, F.lit('{"kind":1,"k":["requests",0')),
        line((1 << 40) + 2, F.lit('{"kind":9}')))
    return append.unionByName(files.select("path", F.inline(others)))


def t_ms(column):
    return F.unix_millis(column.cast("timestamp"))


def normalised(t):
    env = written(J.parse_envelopes(journal_lines(t)))
    sessions = J.session_ids(env)
    return N.normalise_requests(J.replay_journal(env, sessions), sessions, SALT)


PLACED = """SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS turn_index,
  '/home/u/workspaceStorage/ws' || (o_custkey % 20) || '/chatSessions/' || o_custkey || '.jsonl' AS path FROM orders"""
KEPT = f"""SELECT * FROM ({PLACED}) WHERE o_orderkey % 9 <> 0"""
HASH = "substr(sha256('pepper' || {}), 1, 16)"
FILE = HASH.format("'src/f' || (o_orderkey % 50) || '.py'").replace("'src", "'/src")


@query("s04_replay_journal", """SELECT path, turn_index, CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN turn_index = 0 THEN 1099511627776 ELSE o_orderkey * 10 + 10 END AS source_offset,
  CASE WHEN turn_index = 0 THEN 6.25::DOUBLE END AS credits FROM p""", p=PLACED)
def _(t):
    out = J.replay_journal(written(J.parse_envelopes(journal_lines(t))))
    return out.select("path", "turn_index", F.get_json_object("request_json", "$.requestId").alias("request_id"), "source_offset",
                      F.get_json_object("request_json", "$.copilotCredits").cast("double").alias("credits"))


@query("s04_journal_stats", """SELECT path, count(*) + 4 AS total_lines, 1 AS malformed_lines, 1 AS unrecognised_envelopes FROM p GROUP BY path""", p=PLACED)
def _(t):
    stats = J.journal_stats(J.parse_envelopes(journal_lines(t)))
    return stats.withColumns({c: F.col(c).cast("int") for c in ("malformed_lines", "unrecognised_envelopes")})


@query("s05_normalise_requests", f"""SELECT CAST(o_orderkey AS VARCHAR) AS request_id, {HASH.format("'s' || o_custkey")} AS session_id, epoch_ms(o_orderdate) AS ts, o_orderpriority AS model,
  o_orderkey * 10 AS prompt_tokens, o_orderkey % 500 AS output_tokens, CASE WHEN turn_index = 0 THEN 6.25::DOUBLE END AS credits, turn_index,
  'ws' || (o_custkey % 20) || '/chatSessions/' || o_custkey || '.jsonl' AS source_file FROM k""", k=KEPT)
def _(t):
    return N.good(normalised(t)).drop("doc", "drift", "source_offset")


@query("s05_quarantine", """SELECT 'ws' || (o_custkey % 20) || '/chatSessions/' || o_custkey || '.jsonl' AS source_file, turn_index, 'result.metadata.promptTokens' AS drift FROM p WHERE o_orderkey % 9 = 0""", p=PLACED)
def _(t):
    return N.quarantine(normalised(t))


@query("s06_explode_cost_centres", """SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'p' AS category, l AS label, pct AS percentage_of_prompt, CAST(floor(pct / 100 * o_orderkey * 10 + 0.5) AS BIGINT) AS tokens
FROM k, (VALUES ('Files', 6.25::DOUBLE), ('New Label', 30.0::DOUBLE)) v(l, pct)""", k=KEPT)
def _(t):
    return N.explode_cost_centres(N.good(normalised(t)))


@query("s07_explode_rounds", """SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'r' || o_orderkey AS round_id, 5::BIGINT AS ts, CAST(NULL AS VARCHAR) AS model_id, o_orderkey % 7 AS thinking_tokens, 0::BIGINT AS retries FROM k""", k=KEPT)
def _(t):
    return N.explode_rounds(N.good(normalised(t)))


@query("s07_explode_tool_calls", f"""SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'r' || o_orderkey AS round_id, 'c1' AS tool_call_id, 'read_file' AS name, length(o_orderpriority) + length(o_orderstatus) AS result_chars,
  {FILE} AS target_file_hash, 3::BIGINT AS target_start_line, CAST(NULL AS BIGINT) AS target_end_line FROM k""", k=KEPT)
def _(t):
    return N.explode_tool_calls(N.good(normalised(t)), SALT)


@query("s08_explode_compactions", """SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'x' AS tool_call_round_id, 'm' AS model, 2::BIGINT AS num_rounds, 900::BIGINT AS duration_ms, 'success' AS outcome, o_orderkey * 3 AS context_length_before FROM k""", k=KEPT)
def _(t):
    return N.explode_compactions(N.good(normalised(t)))


@query("s09_explode_edits", f"""SELECT CAST(o_orderkey AS VARCHAR) AS request_id, {FILE} AS file_hash, 2::BIGINT AS edit_count, o_orderkey % 2 = 0 AS done FROM k""", k=KEPT)
def _(t):
    return N.explode_edits(N.good(normalised(t)), SALT)


@query("s10_explode_content_references", f"""SELECT CAST(o_orderkey AS VARCHAR) AS request_id, {FILE} AS file_hash FROM k""", k=KEPT)
def _(t):
    return N.explode_content_references(N.good(normalised(t)), SALT)


def as_files(t):
    return t.raw("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("path"), F.timestamp_millis(F.col("doc_id") * 1000).alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))


@query("s03_split_lines", r"""SELECT path, CAST(strlen(array_to_string(parts[:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS BIGINT) AS "offset", regexp_replace(parts[i], '\r$', '') AS line
FROM (SELECT 'd' || doc_id AS path, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_replace(parts[i], '\r$', '') <> ''""")
def _(t):
    return J.split_lines(as_files(t))


@query("s03_read_lines", r"""SELECT ws, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY ws ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  regexp_replace(line, '\r$', '') AS line FROM (SELECT o_orderkey, o_custkey % 7 AS ws, o_orderkey || 'é' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(13) ELSE '' END AS line FROM orders)""")
def _(t):
    """Lines of real files, cut into ranges of 64 kB: one file of sorted orders for each of seven folders."""
    ending = F.when(F.col("o_orderkey") % 3 == 0, "\r").otherwise("")
    rows = t.raw("orders").select((F.col("o_custkey") % 7).alias("ws"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("é"), "o_orderpriority", ending).alias("value"))
    root = f"{checkpoint_dir(t.spark)}/lines-{uuid4().hex}"
    rows.repartition(7, "ws").sortWithinPartitions("ws", "o_orderkey").drop("o_orderkey").write.partitionBy("ws").text(root)
    size = "spark.sql.files.maxPartitionBytes"
    given = t.spark.conf.get(size)
    t.spark.conf.set(size, "64k")
    try:
        lines = materialise(J.read_lines(t.spark, [f"{root}/ws={i}" for i in range(7)]))
    finally:
        t.spark.conf.set(size, given)
    return lines.select(F.regexp_extract("uri", "ws=([0-9]+)/", 1).cast("long").alias("ws"), "offset", "line")


@query("s02_incremental_files", """SELECT 'd' || doc_id AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 <> 0""")
def _(t):
    files = as_files(t)
    empty = t.spark.createDataFrame([], "file_path string, mtime_ms long, size_bytes long, content_hash string")
    seen = J.ingested_state(J.incremental_files(files, empty), 0)
    number = F.substring("file_path", 2, 20).cast("long")
    # A third is unchanged, a third has a newer time, a third new content.
    manifest = seen.withColumn("mtime_ms", F.when(number % 3 == 1, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms"))).withColumn(
        "content_hash", F.when(number % 3 == 2, "x").otherwise(F.col("content_hash")))
    return J.incremental_files(files, manifest).select("path", "content_hash")


@query("s11_upsert_turns", """SELECT request_id, version, credits_x, children FROM (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS credits_x FROM orders)
JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, count(*) FILTER (l_orderkey % 4 <> 0 OR l_linenumber <= 2) AS children FROM lineitem GROUP BY 1) USING (request_id)""")
def _(t):
    o = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("request_id"), "o_orderkey", F.lit("f").alias("source_file"), F.lit(0).alias("source_offset"), F.col("o_totalprice").alias("credits_x"))
    first = o.withColumn("version", F.lit(1).cast("long"))
    second = o.where(F.col("o_orderkey") % 4 == 0).withColumn("credits_x", F.col("credits_x") * 2).withColumn("version", F.lit(2).cast("long"))
    latest = ST.latest_versions(first.unionByName(second))
    lines = t.raw("lineitem").select(F.col("l_orderkey").cast("string").alias("request_id"), "l_orderkey", "l_linenumber")
    children = lines.withColumn("version", F.lit(1).cast("long")).unionByName(
        lines.where((F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") <= 2)).withColumn("version", F.lit(2).cast("long")))
    counts = ST.surviving_children(children, latest).groupBy("request_id").agg(F.count(F.lit(1)).alias("children"))
    lined = lines.select("request_id").distinct()
    return latest.join(lined, "request_id").join(counts, "request_id", "left").select("request_id", "version", "credits_x", F.coalesce("children", F.lit(0)).alias("children"))


@query("s11_sessions", "SELECT session_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM request GROUP BY 1")
def _(t):
    return ST.sessions(t.request)


@query("s12_table_scans", """SELECT 'request' AS name, count(*) AS n FROM request UNION ALL SELECT 'tool_call', count(*) FROM tool_call UNION ALL SELECT 'round', count(*) FROM round
UNION ALL SELECT 'edit', count(*) FROM edit UNION ALL SELECT 'compaction', count(*) FROM compaction UNION ALL SELECT 'content_reference', count(*) FROM content_reference UNION ALL SELECT 'cost_centre', count(*) FROM cost_centre""")
def _(t):
    names = ("request", "tool_call", "round", "edit", "compaction", "content_reference", "cost_centre")
    root = stored(t, *names)
    out = None
    for name in names:
        one = TS.scan(t.spark, root, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def stored(t, *names):
    """A store of the named tables in the shared folder; their requests are few a day, so a folder holds 60 days."""
    root = f"{checkpoint_dir(t.spark)}/store-{uuid4().hex}"
    TS.create({name: getattr(t, name) for name in names}, root, span_days=60)
    return root


@query("s12_day_range", "SELECT request_id, session_id, ts, source_offset FROM request WHERE ts >= 799999999999 AND ts < 830000000000")
def _(t):
    return TS.scan(t.spark, stored(t, "request"), "request", 799_999_999_999, 830_000_000_000).select("request_id", "session_id", "ts", "source_offset")


@query("s11_stored_replace", """SELECT request_id, CASE WHEN model = '1-URGENT' THEN ts + 86400000 ELSE ts END AS ts, CASE WHEN model = '1-URGENT' THEN prompt_tokens * 2 ELSE prompt_tokens END AS prompt_tokens, coalesce(calls, 0) AS calls
FROM request LEFT JOIN (SELECT request_id, count(*) AS calls FROM tool_call JOIN request USING (request_id) WHERE model <> '1-URGENT' OR name = 'read_file' GROUP BY 1) USING (request_id)""")
def _(t):
    """Urgent requests come again a day later, twice as long, and with their file reads alone; the rest stays."""
    root = stored(t, "request", "tool_call")
    again = t.request.where("model = '1-URGENT'").withColumn("ts", F.col("ts") + 86_400_000).withColumn("prompt_tokens", F.col("prompt_tokens") * 2)
    calls = t.tool_call.where("name = 'read_file'").join(again, "request_id", "left_semi")
    TS.replace({"request": again, "tool_call": calls}, root)
    counted = TS.scan(t.spark, root, "tool_call").groupBy("request_id").agg(F.count(F.lit(1)).alias("calls"))
    return TS.scan(t.spark, root, "request").join(counted, "request_id", "left").select("request_id", "ts", "prompt_tokens", F.coalesce("calls", F.lit(0)).alias("calls"))


@query("s13_point_lookup", "SELECT request_id, source_file, source_offset FROM request WHERE request_id = '4242'")
def _(t):
    return TS.locate(t.spark, stored(t, "request"), "4242").select("request_id", "source_file", "source_offset")


@query("s13_fetch_calls", "SELECT * REPLACE (target_start_line::BIGINT AS target_start_line, target_end_line::BIGINT AS target_end_line) FROM tool_call WHERE request_id = (SELECT max(request_id) FROM tool_call)")
def _(t):
    root = stored(t, "request", "tool_call")
    wanted = t.tool_call.agg(F.max("request_id")).first()[0]
    return TS.fetch(t.spark, root, "tool_call", wanted)


def log_records(t):
    key = F.col("o_orderkey")
    subject = F.when(key % 4 == 0, F.concat(F.lit("Merge pull request #"), key)).when(key % 4 == 1, F.concat(F.lit("fix (#"), key, F.lit(")"))).when(
        key % 4 == 2, F.concat(F.lit("This reverts commit "), F.lower(F.hex(key + 268435456)))).otherwise("work")
    header = F.concat_ws("\x1f", key.cast("string"), F.when(key % 11 == 0, F.concat_ws(" ", (key - 1).cast("string"), (key - 2).cast("string"))).otherwise((key - 1).cast("string")),
                         F.concat(F.lit(" U"), F.col("o_custkey"), F.lit("@X.org")), (t_ms(F.col("o_orderdate")) / 1000).cast("long").cast("string"), subject)
    stats = F.concat(F.lit("\n5\t"), key % 10, F.lit("\tsrc/A"), key % 30, F.lit(".PY\n-\t-\timg/.hidden\n"))
    return t.raw("orders").select(F.concat(header, stats).alias("record"))


@query("s14_read_git_log", f"""SELECT CAST(o_orderkey AS VARCHAR) AS sha, {HASH.format("'u' || o_custkey || '@x.org'")} AS author_id, epoch_ms(o_orderdate) AS ts, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS parents,
  o_orderkey % 11 = 0 AS is_merge FROM orders""")
def _(t):
    return G.parse_commits(log_records(t), SALT).select("sha", "author_id", "ts", F.size("parents").alias("parents"), "is_merge")


@query("s14_git_files", f"""SELECT CAST(o_orderkey AS VARCHAR) AS sha, {HASH.format("'/repo/src/a' || (o_orderkey % 30) || '.py'")} AS path_hash, 'py' AS extension, 5::BIGINT AS added, o_orderkey % 10 AS deleted FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), {HASH.format("'/repo/img/.hidden'")}, '', 0, 0 FROM orders""")
def _(t):
    return G.parse_files(G.parse_commits(log_records(t), SALT), SALT, "/repo/")


@query("s15_git_links", """SELECT CAST(o_orderkey AS VARCHAR) AS sha, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS pull_request, CASE WHEN o_orderkey % 4 = 2 THEN lower(printf('%X', o_orderkey + 268435456)) END AS reverts_sha FROM orders""")
def _(t):
    return G.parse_commits(log_records(t), SALT).select("sha", "pull_request", "reverts_sha")


def spans(t):
    key = F.col("event_id")
    value = lambda s=None, i=None, d=None: F.struct(
        (F.lit(None) if s is None else s).cast("string").alias("stringValue"), (F.lit(None) if i is None else i).cast("string").alias("intValue"),
        (F.lit(None) if d is None else d).cast("double").alias("doubleValue"), F.lit(None).cast("boolean").alias("boolValue"))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    attributes = F.array(attr("gen_ai.prompt", value(s=F.lit("secret"))), attr("chat.model", value(s=F.when(key % 10 != 0, F.col("event_type")))),
                         attr("gen_ai.usage.input_tokens", value(i=key)), attr("chat.request.credits", value(d=F.col("value"))), attr("session.id", value(s=F.col("user_id").cast("string"))))
    span = F.struct(F.lit("s").alias("name"), F.when(key % 7 != 0, F.concat(key + 1, F.lit("999999"))).alias("startTimeUnixNano"), attributes.alias("attributes"))
    return t.raw("events").select(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))


@query("s16_read_otel_spans", f"""SELECT event_id + 1 AS ts, event_type AS model, event_id AS prompt_tokens, 0::BIGINT AS output_tokens, value AS credits, {HASH.format("user_id")} AS session_id FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0""")
def _(t):
    return FI.otel_turns(FI.otel_spans(spans(t)), SALT).where("usable").drop("usable", "dropped")


@query("s16_otel_counts", "SELECT count(*) AS spans_seen, count(*) FILTER (event_id % 10 = 0 OR event_id % 7 = 0) AS spans_skipped, count(*) AS content_attributes_dropped FROM events")
def _(t):
    return FI.otel_counts(FI.otel_turns(FI.otel_spans(spans(t)), SALT))


@query("s17_read_roster", f"""SELECT {HASH.format("'dev' || c_custkey || '@x'")} AS unit, CASE WHEN c_custkey % 6 = 0 THEN 'unassigned' ELSE c_mktsegment END AS team, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS pre_spend FROM customer""")
def _(t):
    key = F.col("c_custkey")
    row = F.concat_ws(" , ", F.concat(F.lit("Dev"), key, F.lit("@X")), F.when(key % 6 == 0, "").otherwise(F.col("c_mktsegment")), F.when(key % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(20,2)").cast("string")))
    lines = t.raw("customer").select(row.alias("value"), key.alias("line_no"))
    again = t.raw("customer").select(F.concat(F.lit("dev"), key, F.lit("@x,other,9")).alias("value"), (key + 1_000_000_000).alias("line_no"))
    notes = t.raw("customer").select(F.lit("# note").alias("value"), key.alias("line_no"))
    return FI.parse_roster(lines.unionByName(again).unionByName(notes), SALT)


@query("s18_read_cohorts", f"""SELECT {HASH.format("'team' || c_custkey")} AS unit, CASE WHEN c_custkey % 3 > 0 THEN DATE '2024-01-15' END AS treated_on FROM customer""")
def _(t):
    key = F.col("c_custkey")
    row = F.concat(F.lit("Team"), key, F.when(key % 3 == 0, "").when(key % 3 == 1, ",2024-01-15").otherwise(", 2024-01-15 "))
    return FI.parse_cohorts(t.raw("customer").select(row.alias("value")), SALT)


@query("s19_read_bundles", """SELECT CAST(c_custkey AS VARCHAR) AS install_id, c_mktsegment AS team, round(c_acctbal, 2) AS total_credits, 1 AS models FROM customer WHERE c_custkey % 4 > 1""")
def _(t):
    key = F.col("c_custkey")
    text = F.to_json(F.struct(F.when(key % 4 == 0, 2).otherwise(1).alias("bundleVersion"), key.cast("string").alias("installId"), F.col("c_mktsegment").alias("team"), F.col("c_acctbal").alias("totalCredits"),
        F.array(F.struct(F.lit("m").alias("model"), F.lit(1.0).alias("credits"), F.lit(1).alias("requests"))).alias("byModel"), F.when(key % 4 != 1, F.array(F.struct(F.lit("team").alias("field"), F.lit("x").alias("why")))).alias("manifest")))
    parsed = t.raw("customer").select(F.from_json(text, FI.BUNDLE).alias("b")).select("b.*")
    return rounded(FI.valid_bundles(parsed).select("install_id", "team", "total_credits", F.size("by_model").alias("models")), 2)


@query("s21_read_workspace_map", """SELECT 'w' || page_id AS workspace_id, CASE page_id % 5 WHEN 0 THEN 'c:/my proj/p' || page_id WHEN 1 THEN NULL END AS canonical_path, CASE WHEN page_id % 5 = 0 THEN 'p' || page_id END AS label,
  CASE page_id % 5 WHEN 1 THEN 'no-workspace-json' WHEN 2 THEN 'malformed-workspace-json' WHEN 3 THEN 'multi-root-workspace' WHEN 4 THEN 'empty-window' END AS unattributed_reason FROM pages""")
def _(t):
    key = F.col("page_id")
    text = (F.when(key % 5 == 0, F.concat(F.lit('{"folder":"file:///C%3A/My%20Proj//p'), key, F.lit('"}'))).when(key % 5 == 2, "{oops").when(key % 5 == 3, '{"workspace":"x"}').when(key % 5 == 4, '{"folder":" "}'))
    rows = t.raw("pages").select(F.concat(F.lit("w"), key).alias("workspace_id"), text.alias("text"))
    return FI.read_workspace_map(rows, rows.where(F.col("text").isNotNull())).drop("display_path")


@query("f01_scalar_paths", f"""SELECT page_id, c AS canonical, {HASH.format('c')} AS hashed, substr({HASH.format('c')}, 1, 8) AS short, regexp_extract(c, '([^/]*)$', 1) AS tail FROM (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://', ''), '/+', '/', 'g')) AS c FROM pages)""")
def _(t):
    c = S.canonicalise_path(F.col("url"))
    return t.raw("pages").select("page_id", c.alias("canonical"), S.hash_path(F.col("url"), SALT).alias("hashed"), S.short_id(S.hash_path(F.col("url"), SALT)).alias("short"), F.regexp_extract(c, "([^/]*)$", 1).alias("tail"))


@query("f03_redacted_paths", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'ws' || o_custkey || '/c.jsonl' WHEN o_orderkey % 4 = 1 THEN 'C:\\Users\\a' WHEN o_orderkey % 4 = 2 THEN 'src/a.py' ELSE '/etc/x' END AS relative, o_orderkey % 4 IN (0, 2) AS redacted FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    raw = F.when(key % 4 == 0, F.concat(F.lit("/home/a/workspaceStorage/ws"), "o_custkey", F.lit("/c.jsonl"))).when(key % 4 == 1, "C:\\Users\\a").when(key % 4 == 2, "src/a.py").otherwise("/etc/x")
    rel = S.to_relative_path(raw)
    return t.raw("orders").select("o_orderkey", rel.alias("relative"), S.is_path_redacted(rel).alias("redacted"))


@query("f04_measure_result_chars", r"""SELECT doc_id, coalesce(length(lang), 0) + 2 * coalesce(length(source), 0) + coalesce(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')), 0) AS chars FROM documents""")
def _(t):
    tree = F.to_json(F.struct(F.lit("x").alias("type"), F.col("lang").alias("a"), F.array(F.struct(F.col("source").alias("b")), F.struct(F.col("source").alias("b"))).alias("c"), F.col("doc_id").alias("n"), F.col("text").alias("t")))
    return t.raw("documents").select("doc_id", N.measure_result_chars(tree).alias("chars"))


@query("f05_small_scalars", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity / 4 + 0.5) AS BIGINT) AS tokens, round(l_tax * 0.01, 8) AS usd, round(l_quantity / (l_quantity + 20), 8) AS confidence,
  CASE WHEN l_quantity <= 5 THEN '1-5' WHEN l_quantity <= 20 THEN '6-20' ELSE '21-50' END AS bucket, CASE WHEN l_quantity <= 10 THEN 'low' WHEN l_quantity <= 30 THEN 'medium' ELSE 'high' END AS band,
  round(1 - (1 - l_discount) * 0.7, 8)::DOUBLE AS damped, CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.tokens_from_chars(q).alias("tokens"), S.credits_to_usd(F.col("l_tax")).alias("usd"), S.sample_confidence(q).alias("confidence"),
        S.length_bucket(q).alias("bucket"), S.band_of(q, F.lit(10), F.lit(30)).alias("band"), S.damp(F.col("l_discount"), S.realisation(F.lit("A"), "low")).alias("damped"), S.week_start(F.to_date("l_shipdate")).alias("week")), 8)


@query("j03_find_rates", """SELECT model, (SELECT round(rate, 6) FROM rate_card c WHERE c.model = upper(replace(w.model, '_', '-'))) AS rate
FROM (SELECT DISTINCT unnest([o_orderpriority, lower(replace(o_orderpriority, '-', '_'))]) AS model FROM orders) w""")
def _(t):
    from ..operators.pricing import derive_rate_card, find_rates

    named = t.request.select(F.explode(F.array("model", F.lower(F.translate("model", "-", "_")))).alias("model")).distinct()
    return rounded(find_rates(named, derive_rate_card(t.request)).select("model", "rate"), 6)
