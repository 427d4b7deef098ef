"""The twelve priced waste classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.ordered import row_numbers
from ...functions.quantiles import med_upper, q_ceil, q_floor, rank_pick
from ...functions.scalars import tokens_from_chars
from ...session import attach, join_dimension, materialise, written
from ..corpus import READ_TOOLS, Corpus
from ..duplication import MIN_GROUP_SIZE, detect_duplication, duplication_summary
from ..pricing import cheapest_measured, find_rates
from .complexity import LOW_SHARE, complexity_scores
from .findings import confidence, finding, item, percent, worst

HOUR_MS = 3_600_000
SETTLING_MS = 2 * HOUR_MS


def per_token() -> Column:
    return F.col("credits_per_token")


def centre_tokens(corpus: Corpus, label: str) -> DataFrame:
    """Tokens of one cost-centre label per request."""
    return corpus.centre_tokens(label)


def tool_definition_tax(corpus: Corpus) -> DataFrame:
    """W1: descriptions of tools called on fewer than one request in twenty."""
    by = corpus.by
    centres = corpus.cost_centre.groupBy(*by).agg(
        F.sum(F.when(F.col("label") == "Tool Definitions", F.col("tokens"))).alias("defined"),
        F.sum("tokens").alias("decomposed"),
    )
    tools = attach(
        written(corpus.tool_call.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("calls"))), corpus.totals, by
    ).withColumn("rare", F.col("calls") / F.greatest(F.lit(1), F.col("requests")) < 0.05)
    surface = tools.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tools"), F.count(F.when(F.col("rare"), 1)).alias("rare_tools")
    )
    stats = attach(attach(surface, centres, by), corpus.totals, by).where(F.col("defined") > 0)
    share = F.col("defined") / F.col("decomposed")
    each = F.col("defined") / F.col("tools")
    listed = worst(
        tools.where("rare"), by, item("tool", F.col("name"), F.col("calls")),
        [F.col("calls"), F.col("name")], 12,
    )
    return finding(
        stats, by, "W1", "A",
        F.concat(F.lit("Tool schemas take up "), percent(share), F.lit(" of what is sent")),
        F.col("rare_tools") * each * per_token(),
        confidence(F.col("requests"), 30, share / 0.25),
        [item("tool", "ALL", F.col("requests"), F.col("defined")),
         item("tool", "APPORTIONMENT", F.col("tools"), each)],
        listed,
    )


def duplicate_retrieval(corpus: Corpus) -> DataFrame:
    """W2: characters of reads already in context, with no edit in between."""
    by = corpus.by
    scan = corpus.rereads
    reads = corpus.read_calls.groupBy(*by).agg(F.count(F.lit(1)).alias("reads"))
    found = scan.groupBy(*by).agg(
        F.count(F.when(F.col("duplicate"), 1)).alias("duplicates"),
        F.count(F.when(~F.col("duplicate"), 1)).alias("refreshed"),
        F.sum(F.when(F.col("duplicate"), F.col("chars"))).alias("chars"),
    )
    per_file = (
        scan.where("duplicate")
        .groupBy(*by, "session_id", "file_hash")
        .agg(F.count(F.lit(1)).alias("repeats"), F.sum("chars").alias("chars"))
    )
    listed = worst(
        per_file, by, item("file", F.col("file_hash"), F.col("repeats"), F.col("chars")),
        [-F.col("chars"), F.col("session_id"), F.col("file_hash")], 10,
    )
    stats = attach(attach(found, reads, by), corpus.totals, by).where(F.col("duplicates") > 0)
    rate = F.col("duplicates") / F.col("reads")
    return finding(
        stats, by, "W2", "B",
        F.concat(F.lit("Repeated reads of text still held: "), percent(rate)),
        tokens_from_chars(F.col("chars")) * per_token(),
        confidence(F.col("reads"), 50, rate / 0.3),
        [item("file", "ALL", F.col("duplicates"), F.col("reads")),
         item("file", "REFRESHED", F.col("refreshed"))],
        listed,
    )


ABSOLUTE_CAP_CHARS = 16_000


def oversized_results(corpus: Corpus) -> DataFrame:
    """Tool results above max(16 000, 20 medians) of their own tool."""
    by = corpus.by
    measured = corpus.tool_call.where(F.col("result_chars").isNotNull())
    norms = rank_pick(measured, "result_chars", {"median": med_upper}, [*by, "name"], "tool_calls")
    limits = norms.where(F.col("tool_calls") >= 10).select(
        *by,
        "name",
        F.greatest(F.lit(ABSOLUTE_CAP_CHARS), F.col("median") * 20).alias("threshold"),
    )
    return measured.join(limits, [*by, "name"]).where(F.col("result_chars") > F.col("threshold"))


def oversized_payloads(corpus: Corpus) -> DataFrame:
    """W3: characters above the per-tool ceiling."""
    by = corpus.by
    offenders = written(oversized_results(corpus))
    sample = corpus.tool_call.groupBy(*by).agg(F.count("result_chars").alias("measured"))
    excess = offenders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("offenders"),
        F.sum(F.col("result_chars") - F.col("threshold")).alias("chars"),
        F.max(F.struct("result_chars", "name")).alias("largest"),
    )
    stats = attach(attach(excess, sample, by), corpus.totals, by).where(
        (F.col("measured") >= 50) & (F.col("offenders") > 0)
    )
    listed = worst(
        offenders, by, item("request", F.col("request_id"), None, F.col("result_chars")),
        [-F.col("result_chars"), F.col("request_id"), F.col("tool_call_id")], 10,
    )
    return finding(
        stats, by, "W3", "B",
        F.concat(F.lit("Largest tool output, from "), F.col("largest.name"), F.lit(", in tokens: "),
                 tokens_from_chars(F.col("largest.result_chars")).cast("string")),
        tokens_from_chars(F.col("chars")) * per_token(),
        confidence(F.col("measured"), 200, F.col("offenders") / (F.col("measured") * 0.01)),
        item("tool", "ALL", F.col("offenders"), F.col("chars")),
        listed,
    )


STALE_TURNS, BASELINE_TURNS = 8, 3


def opening_turns(corpus: Corpus, turns: int = STALE_TURNS) -> DataFrame:
    """Per session: turns, mean prompt of the first three, and the place of turn `turns`.

    Only the first few rows of a session are ranked; Spark cuts each input partition to
    that many rows per session before the shuffle.
    """
    keys = [*corpus.by, "session_id"]
    place = F.struct("turn_index", "ts", "request_id")
    from pyspark.sql import Window

    ranked = corpus.request.select(*keys, "prompt_tokens", place.alias("place")).withColumn(
        "turn", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    )
    head = ranked.where(F.col("turn") <= max(turns, BASELINE_TURNS)).groupBy(*keys).agg(
        F.avg(F.when(F.col("turn") <= BASELINE_TURNS, F.col("prompt_tokens"))).alias("baseline"),
        F.max(F.when(F.col("turn") == turns, F.col("place"))).alias("last_fresh"),
    )
    return head.where(F.col("last_fresh").isNotNull())


def stale_turns(corpus: Corpus, turns: int = STALE_TURNS) -> DataFrame:
    """Requests after turn `turns` of their session, with the session's early baseline."""
    keys = [*corpus.by, "session_id"]
    place = F.struct("turn_index", "ts", "request_id")
    return corpus.request.join(opening_turns(corpus, turns), keys).where(
        (place > F.col("last_fresh")) & (F.col("baseline") > 0)
    )


def session_staleness(corpus: Corpus) -> DataFrame:
    """W4: prompt growth after turn eight over the session's first three turns."""
    by = corpus.by
    over = F.col("prompt_tokens") - F.col("baseline")
    late = stale_turns(corpus).where(over > 0)
    per_session = written(
        late.groupBy(*by, "session_id").agg(F.count(F.lit(1)).alias("stale"), F.sum(over).alias("excess"))
    )
    sessions = corpus.request.groupBy(*by, "session_id").agg(F.count(F.lit(1)).alias("turns"))
    counted = sessions.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"))
    found = per_session.groupBy(*by).agg(
        F.count(F.lit(1)).alias("offenders"),
        F.sum("stale").alias("stale"),
        F.sum("excess").alias("excess"),
    )
    stats = attach(attach(found, counted, by), corpus.totals, by).where(F.col("offenders") > 0)
    listed = worst(
        per_session, by, item("session", F.col("session_id"), F.col("stale"), F.col("excess")),
        [F.round(-F.col("excess"), 4), F.col("session_id")], 10,
    )
    return finding(
        stats, by, "W4", "C",
        F.concat(F.lit("Old turns sent again in long sessions, in tokens: "),
                 F.round("excess").cast("long").cast("string")),
        F.col("excess") * per_token(),
        confidence(F.col("stale"), 40, F.col("offenders") / F.greatest(F.lit(1), F.col("sessions"))),
        item("session", "ALL", F.col("offenders"), F.col("excess")),
        listed,
    )


def over_selected_requests(corpus: Corpus) -> DataFrame:
    """Simple requests that a much cheaper measured model could have served."""
    by = corpus.by
    scores = complexity_scores(corpus)
    ceiling = rank_pick(scores, "score", {"ceiling": q_floor(LOW_SHARE)}, by, count_as="scored")
    floor = cheapest_measured(corpus.card, by)
    premium = attach(corpus.card.where(F.col("provenance") == "measured"), floor, by).where(
        (F.col("measured_models") >= 2) & (F.col("rate") / F.col("cheapest_rate") >= 3)
    )
    # `premium` is a filter of the checkpointed card, so counting it is free.
    rows = join_dimension(
        corpus.priced, premium.select(*by, "model", "cheapest_rate", "cheapest_model"),
        [*by, "model"], "inner",
    )
    rows = attach(rows.join(scores, [*by, "request_id"]), ceiling, by)
    saving = F.col("price") - F.col("prompt_tokens") / 1000 * F.col("cheapest_rate")
    return rows.withColumn("saving", saving).where(
        (F.col("scored") >= 20) & (F.col("score") <= F.col("ceiling")) & (F.col("saving") > 0)
    )


def model_over_selection(corpus: Corpus) -> DataFrame:
    """W5."""
    by = corpus.by
    flagged = over_selected_requests(corpus)
    per_model = written(
        flagged.groupBy(*by, "model").agg(
            F.count(F.lit(1)).alias("requests_flagged"), F.sum("saving").alias("saving")
        )
    )
    found = per_model.groupBy(*by).agg(
        F.sum("requests_flagged").alias("flagged"), F.sum("saving").alias("saving")
    )
    stats = attach(found, cheapest_measured(corpus.card, by), by).where(F.col("flagged") > 0)
    spread = F.col("dearest_rate") / F.col("cheapest_rate")
    listed = worst(
        per_model, by,
        item("model", F.col("model"), F.col("requests_flagged"), None, F.col("saving")),
        [-F.col("saving"), F.col("model")], 8,
    )
    return finding(
        stats, by, "W5", "A",
        F.concat(F.lit("Easy requests sent to an expensive model: "), F.col("flagged").cast("string")),
        F.col("saving"),
        confidence(F.col("flagged"), 30, spread / 10),
        item("model", F.col("cheapest_model"), None, F.col("cheapest_rate")),
        listed,
    )


def runaway_requests(corpus: Corpus) -> DataFrame:
    """Requests as deep as the top decile that completed no edit."""
    by = corpus.by
    keys = [*by, "request_id"]
    counted = corpus.request.join(corpus.round_counts, keys, "left").select(
        *keys, F.coalesce("rounds", F.lit(0)).alias("depth"), F.col("rounds").isNotNull().alias("looped")
    )
    limits = rank_pick(counted, "depth", {"decile": q_ceil(0.9)}, by)
    looped = corpus.round_counts.groupBy(*by).agg(F.count(F.lit(1)).alias("looped_requests"))
    finished = corpus.edit.where(F.col("done") & (F.col("edit_count") > 0)).select(*keys).distinct()
    # Depth zero can never reach the floor of ten rounds, so only looped requests are kept.
    deep = attach(attach(corpus.round_counts, limits, by), looped, by).withColumn(
        "threshold", F.greatest(F.lit(10), F.col("decile"))
    ).where((F.col("looped_requests") >= 20) & (F.col("rounds") >= F.col("threshold")))
    return deep.join(finished, keys, "left_anti").join(
        corpus.priced.select(*keys, "price"), keys
    )


def runaway_loops(corpus: Corpus) -> DataFrame:
    """W6: the whole price of deep loops that produced nothing."""
    by = corpus.by
    offenders = written(runaway_requests(corpus))
    stats = offenders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("offenders"),
        F.sum("price").alias("price"),
        F.max("rounds").alias("deepest"),
        F.max("threshold").alias("threshold"),
    ).where(F.col("offenders") > 0)
    listed = worst(
        offenders, by,
        item("request", F.col("request_id"), F.col("rounds"), None, F.col("price")),
        [F.round(-F.col("price"), 6), F.col("request_id")], 10,
    )
    return finding(
        stats, by, "W6", "B",
        F.concat(F.lit("Long tool runs that changed no file: "), F.col("offenders").cast("string")),
        F.col("price"),
        confidence(F.col("offenders"), 15, F.lit(0.7)),
        item("request", "ALL", F.col("offenders"), F.col("deepest")),
        listed,
    )


def judged_edits(corpus: Corpus) -> DataFrame:
    """Every edit as 'recent', 'untracked', 'survived' or 'lost' against commit history."""
    by = corpus.by
    commits = corpus.commit_file.where(~F.col("is_merge"))
    latest = commits.groupBy(*by, F.col("path_hash").alias("file_hash")).agg(
        F.max("ts").alias("latest_commit")
    )
    ends = (
        corpus.request.select(*by, "ts").unionByName(commits.select(*by, "ts"))
        .groupBy(*by)
        .agg((F.max("ts") - SETTLING_MS).alias("judge_before"))
    )
    rows = attach(
        corpus.edit.join(corpus.request.select(*by, "request_id", "ts"), [*by, "request_id"]), ends, by
    ).join(latest, [*by, "file_hash"], "left")
    verdict = (
        F.when(F.col("ts") > F.col("judge_before"), "recent")
        .when(F.col("latest_commit").isNull(), "untracked")
        .when(F.col("latest_commit") >= F.col("ts"), "survived")
        .otherwise("lost")
    )
    return rows.select(*by, "request_id", "file_hash", verdict.alias("verdict"))


def judged_requests(corpus: Corpus, edits: DataFrame | None = None) -> DataFrame:
    """Requests with at least one judged edit; one surviving file saves the request."""
    return (
        (judged_edits(corpus) if edits is None else edits)
        .where(F.col("verdict").isin("survived", "lost"))
        .groupBy(*corpus.by, "request_id")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.bool_or(F.col("verdict") == "survived").alias("survived"),
        )
    )


def survival_coverage(corpus: Corpus, edits: DataFrame | None = None) -> DataFrame:
    """Gate of W7: how much of the edited work this history can judge."""
    by = corpus.by
    edits = written(judged_edits(corpus)) if edits is None else edits
    kinds = edits.groupBy(*by).agg(
        F.count(F.when(F.col("verdict").isin("survived", "lost"), 1)).alias("judged_files"),
        F.count(F.when(F.col("verdict") == "untracked", 1)).alias("untracked_files"),
        F.count(F.when(F.col("verdict") == "recent", 1)).alias("too_recent"),
    )
    requests = judged_requests(corpus, edits).groupBy(*by).agg(
        F.count(F.lit(1)).alias("judged_requests")
    )
    judged = F.coalesce("judged_requests", F.lit(0))
    coverage = F.col("judged_files") / F.greatest(
        F.lit(1), F.col("judged_files") + F.col("untracked_files")
    )
    return attach(kinds, requests, by).select(
        *by,
        judged.alias("judged_requests"),
        "judged_files",
        "untracked_files",
        "too_recent",
        coverage.alias("coverage"),
        ((judged >= 20) & (coverage >= 0.5)).alias("sufficient"),
    )


def abandoned_work(corpus: Corpus) -> DataFrame:
    """W7: price of requests none of whose tracked edits was committed afterwards."""
    by = corpus.by
    if corpus.commit_file is None:
        return no_findings(corpus)
    edits = written(judged_edits(corpus))
    lost = written(
        judged_requests(corpus, edits).where(~F.col("survived")).join(
            corpus.priced.select(*by, "request_id", "price"), [*by, "request_id"]
        )
    )
    found = lost.groupBy(*by).agg(
        F.count(F.lit(1)).alias("abandoned"), F.sum("price").alias("price")
    )
    stats = attach(found, survival_coverage(corpus, edits), by).where(
        F.col("sufficient") & (F.col("abandoned") > 0)
    )
    rate = F.col("abandoned") / F.col("judged_requests")
    listed = worst(
        lost, by, item("request", F.col("request_id"), F.col("files"), None, F.col("price")),
        [F.round(-F.col("price"), 6), F.col("request_id")], 10,
    )
    return finding(
        stats, by, "W7", "C",
        F.concat(F.lit("Edits that never reached a commit: "), percent(rate)),
        F.col("price"),
        confidence(F.col("judged_requests"), 40, rate / 0.5),
        [item("request", "ALL", F.col("abandoned"), None, F.col("price")),
         item("file", "UNTRACKED", F.col("untracked_files"), F.col("coverage")),
         item("request", "SETTLING", F.col("too_recent"))],
        listed,
    )


def cross_developer_duplication(corpus: Corpus) -> DataFrame:
    """W8: repeat answers to a question asked by five or more developers."""
    by = corpus.by
    if corpus.question is None:
        return no_findings(corpus)
    clusters = detect_duplication(corpus.question, by).where(~F.col("suppressed"))
    found = clusters.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shown"),
        F.sum("redundant_credits").alias("redundant"),
        F.sum("occurrences").alias("occurrences"),
    )
    stats = attach(found, duplication_summary(corpus.question, by), by).where(
        (F.col("developers_seen") >= MIN_GROUP_SIZE) & (F.col("shown") > 0) & (F.col("redundant") > 0)
    )
    listed = worst(
        clusters, by,
        item("session", F.col("question_hash"), F.col("occurrences"), None, F.col("redundant_credits")),
        [F.round(-F.col("redundant_credits"), 6), F.col("question_hash")], 10,
    )
    return finding(
        stats, by, "W8", "A",
        F.concat(F.lit("Spent on questions asked before: "), percent(F.col("redundant_share"))),
        F.col("redundant"),
        confidence(F.col("questions_seen"), 500, F.col("redundant_share") / 0.1),
        [item("session", "ALL", F.col("shown"), F.col("occurrences"), F.col("redundant")),
         item("session", "SUPPRESSED", F.col("suppressed_clusters"))],
        listed,
    )


def compaction_overhead(corpus: Corpus) -> DataFrame:
    """W9: context length of every automatic summarisation."""
    by = corpus.by
    events = written(
        corpus.compaction.select(*by, "request_id", "tool_call_round_id", "duration_ms", "outcome", "context_length_before")
    )
    found = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("context_length_before").alias("tokens"),
        F.sum("duration_ms").alias("wait_ms"),
        F.count(F.when(~F.lower("outcome").contains("success"), 1)).alias("failed"),
    )
    typical = rank_pick(events, "duration_ms", {"median_wait_ms": med_upper}, by)
    stats = attach(attach(found, typical, by), corpus.totals, by).where(F.col("events") > 0)
    hours = F.col("wait_ms") / HOUR_MS
    listed = worst(
        events, by, item("request", F.col("request_id"), None, F.col("context_length_before")),
        [-F.col("context_length_before"), F.col("request_id"), F.col("tool_call_round_id")], 8,
    )
    return finding(
        stats, by, "W9", "C",
        F.concat(F.lit("Hours that sessions stood still for compaction: "),
                 F.round(hours, 1).cast("string")),
        F.col("tokens") * per_token(),
        confidence(F.col("events"), 10, F.lit(0.9)),
        [item("request", "ALL", F.col("events"), F.col("median_wait_ms")),
         item("request", "FAILED", F.col("failed"))],
        listed,
    )


def instruction_series(corpus: Corpus) -> DataFrame:
    """Requests with system-instruction tokens, in time order, split at the baseline."""
    by = corpus.by
    series = corpus.requests_with("System Instructions").select(*by, "request_id", "ts", "tokens")
    placed = row_numbers(
        series, by, F.floor(F.col("ts") / HOUR_MS), [F.col("ts"), F.col("request_id")], "place"
    )
    size = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return attach(placed, size, by).withColumn(
        "late", F.col("place") > F.greatest(F.lit(20), F.floor(F.col("n") * 0.25))
    )


def instruction_bloat(corpus: Corpus) -> DataFrame:
    """W10: system instructions above the corpus's own early median."""
    by = corpus.by
    series = written(instruction_series(corpus).select(*by, "tokens", "late"))
    medians = rank_pick(series, "tokens", {"median": med_upper}, [*by, "late"], count_as="size")
    split = medians.groupBy(*by).agg(
        F.max(F.when(~F.col("late"), F.col("median"))).alias("baseline"),
        F.max(F.when(F.col("late"), F.col("median"))).alias("current"),
        F.coalesce(F.max(F.when(F.col("late"), F.col("size"))), F.lit(0)).alias("later"),
    )
    growth = (F.col("current") - F.col("baseline")) / F.col("baseline")
    over = F.col("tokens") - F.col("baseline")
    found = attach(series, split, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("later").alias("later"),
        F.max("baseline").alias("baseline"),
        F.max("current").alias("current"),
        F.sum(F.when(F.col("late") & (over > 0), over).otherwise(F.lit(0))).alias("excess"),
        F.count(F.when(F.col("late") & (over > 0), 1)).alias("above"),
    )
    stats = attach(found, corpus.totals, by).where(
        (F.col("n") >= 60) & (F.col("later") >= 20) & (F.col("baseline") > 0) & (growth >= 0.15)
    )
    return finding(
        stats, by, "W10", "C",
        F.concat(F.lit("Fixed part of each prompt is longer than before by "), percent(growth)),
        F.col("excess") * per_token(),
        confidence(F.col("n"), 200, growth),
        [item("request", "BASELINE", F.col("n") - F.col("later"), F.col("baseline")),
         item("request", "CURRENT", F.col("later"), F.col("current")),
         item("request", "ALL", F.col("above"), F.col("excess"))],
    )


def opened_files(corpus: Corpus) -> DataFrame:
    """Distinct (session, file) that some read tool opened."""
    return (
        corpus.calls.where(F.col("name").isin(*READ_TOOLS) & F.col("target_file_hash").isNotNull())
        .select(*corpus.by, "session_id", F.col("target_file_hash").alias("file_hash"))
        .distinct()
    )


def judged_references(corpus: Corpus) -> DataFrame:
    """References with the Files tokens each carries and whether the session opened them."""
    by = corpus.by
    keys = [*by, "request_id"]
    per_request = corpus.content_reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("references"))
    files = centre_tokens(corpus, "Files")
    priced = (
        per_request.join(files, keys, "left")
        .join(corpus.request.select(*keys, "session_id"), keys)
        .select(*keys, "session_id",
                F.when(F.col("tokens") > 0, F.col("tokens") / F.col("references")).alias("share"))
    )
    opened = opened_files(corpus).withColumn("opened", F.lit(True))
    return (
        corpus.content_reference.join(priced, keys)
        .join(opened, [*by, "session_id", "file_hash"], "left")
        .withColumn("opened", F.coalesce("opened", F.lit(False)))
    )


def reference_leakage(corpus: Corpus) -> DataFrame:
    """W11: Files tokens of references that the session never opened."""
    by = corpus.by
    references = written(judged_references(corpus).select(*by, "session_id", "share", "opened"))
    leaked = ~F.col("opened") & F.col("share").isNotNull()
    found = references.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count("share").alias("judged"),
        F.count(F.when(leaked, 1)).alias("unopened"),
        F.sum(F.when(leaked, F.col("share"))).alias("tokens"),
        F.count(F.when(F.col("share").isNull(), 1)).alias("unpriceable"),
    )
    rate = F.col("unopened") / F.col("judged")
    stats = attach(found, corpus.totals, by).where(
        (F.col("seen") >= 50) & (F.col("judged") >= 50) & (F.col("unopened") > 0) & (rate >= 0.25)
    )
    per_session = references.where(leaked).groupBy(*by, "session_id").agg(
        F.count(F.lit(1)).alias("unopened"), F.sum("share").alias("tokens")
    )
    listed = worst(
        per_session, by, item("session", F.col("session_id"), F.col("unopened"), F.col("tokens")),
        [F.round(-F.col("tokens"), 4), F.col("session_id")], 10,
    )
    return finding(
        stats, by, "W11", "B",
        F.concat(F.lit("Attached files left unread: "), percent(rate)),
        F.col("tokens") * per_token(),
        confidence(F.col("judged"), 200, rate / 0.6),
        [item("file", "ALL", F.col("unopened"), F.col("judged")),
         item("file", "UNPRICEABLE", F.col("unpriceable"))],
        listed,
    )


def substep_rounds(corpus: Corpus) -> DataFrame:
    """Rounds that named another model than their request's (counted, never priced)."""
    by = corpus.by
    named = corpus.round.where(F.col("model_id").isNotNull())
    return named.join(
        corpus.request.select(*by, "request_id", F.col("model").alias("request_model")),
        [*by, "request_id"],
    ).where(F.col("model_id") != F.col("request_model"))


def model_rates(corpus: Corpus) -> DataFrame:
    """Materialised rate of every model that requests, compactions or rounds name."""
    by = corpus.by
    named = (
        corpus.compaction.select(*by, "model")
        .unionByName(corpus.round.select(*by, F.col("model_id").alias("model")))
        .where(F.col("model").isNotNull())
        .distinct()
    )
    return materialise(find_rates(named, corpus.card, by))


def utility_model_drift(corpus: Corpus) -> DataFrame:
    """W12: context summarised on a model over twice the cheapest measured rate."""
    by = corpus.by
    floor = cheapest_measured(corpus.card, by)
    rates = model_rates(corpus)
    events = attach(written(join_dimension(corpus.compaction, rates, [*by, "model"])), floor, by)
    dear = F.coalesce(F.col("rate") > F.col("cheapest_rate") * 2, F.lit(False))
    judged = F.coalesce(F.col("provenance") == "measured", F.lit(False))
    cost = F.col("context_length_before") / 1000 * (F.col("rate") - F.col("cheapest_rate"))
    found = events.groupBy(*by).agg(
        F.count(F.when(judged, 1)).alias("judged"),
        F.count(F.when(~judged, 1)).alias("unpriceable"),
        F.count(F.when(judged & dear, 1)).alias("drifted"),
        F.sum(F.when(judged & dear, cost)).alias("excess"),
        F.max("cheapest_model").alias("cheapest_model"),
    )
    steps = attach(
        join_dimension(
            substep_rounds(corpus).groupBy(*by, F.col("model_id").alias("model")).agg(
                F.count(F.lit(1)).alias("n")
            ),
            rates, [*by, "model"],
        ), floor, by,
    ).groupBy(*by).agg(
        F.sum("n").alias("sub_steps"), F.sum(F.when(dear, F.col("n"))).alias("sub_steps_dear")
    )
    rate = F.col("drifted") / F.col("judged")
    stats = attach(found, steps, by).where(
        F.col("cheapest_model").isNotNull() & (F.col("judged") >= 10) & (F.col("drifted") > 0)
    )
    listed = worst(
        events.where(judged & dear).withColumn("cost", cost), by,
        item("request", F.col("request_id"), None, F.col("context_length_before"), F.col("cost")),
        [F.round(-F.col("cost"), 6), F.col("request_id"), F.col("tool_call_round_id")], 10,
    )
    return finding(
        stats, by, "W12", "A",
        F.concat(F.lit("Compactions done by an expensive model: "), percent(rate)),
        F.col("excess"),
        confidence(F.col("judged"), 20, rate / 0.5),
        [item("model", "ALL", F.col("drifted"), None, F.col("excess")),
         item("model", "SUB-STEPS", F.coalesce("sub_steps_dear", F.lit(0)), F.coalesce("sub_steps", F.lit(0))),
         item("model", "UNPRICEABLE", F.col("unpriceable"))],
        listed,
    )


def no_findings(corpus: Corpus) -> DataFrame:
    """An empty finding table, for a detector whose input was not supplied."""
    empty = corpus.request.limit(0)
    return finding(empty, corpus.by, "", "", F.lit(""), F.lit(0.0), F.lit(0.0))


DETECTORS: dict[str, Callable[[Corpus], DataFrame]] = {
    "W1": tool_definition_tax,
    "W2": duplicate_retrieval,
    "W3": oversized_payloads,
    "W4": session_staleness,
    "W5": model_over_selection,
    "W6": runaway_loops,
    "W7": abandoned_work,
    "W8": cross_developer_duplication,
    "W9": compaction_overhead,
    "W10": instruction_bloat,
    "W11": reference_leakage,
    "W12": utility_model_drift,
}
