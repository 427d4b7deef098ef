"""Reports built from several operators."""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import med_upper, rank_pick
from ..functions.scalars import credits_to_usd, day_key, length_bucket, measured_percent, month_bounds, provenance_kind
from ..operators import budget as B
from ..operators import ledger as L
from ..operators.corpus import Corpus
from ..operators.duplication import duplication_summary
from ..operators.privacy import redact_evidence
from ..operators.waste.detectors import (
    DETECTORS,
    centre_tokens,
    no_findings,
    opened_files,
    survival_coverage,
)
from ..session import attach


def waste_findings(corpus: Corpus, scope: str = "shared", subjects: int = 1) -> DataFrame:
    """All findings, dearest first.

    A detector that fails stops the report and is named in the error: without it the rest would look whole.
    """
    out, corpus.shared = no_findings(corpus), True
    for name, detect in DETECTORS.items():
        try:
            out = out.unionByName(detect(corpus))
        except Exception as error:
            error.add_note(f"waste detector {name}")
            raise
    out = redact_evidence(out, subjects, scope)
    return out.orderBy(F.col("credits").desc(), "class")


def waste_report(corpus: Corpus) -> DataFrame:
    """Attributed share of spend, with a warning when causes overlap past the total."""
    by = corpus.by
    sums = waste_findings(corpus).groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"), F.sum("credits").alias("attributed_credits")
    )
    rows = attach(corpus.totals.select(*by, "total_credits"), sums, by)
    attributed = F.coalesce("attributed_credits", F.lit(0.0))
    return rows.select(
        *by,
        "total_credits",
        F.coalesce("findings", F.lit(0)).alias("findings"),
        attributed.alias("attributed_credits"),
        F.when(F.col("total_credits") > 0, attributed / F.col("total_credits"))
        .otherwise(0.0)
        .alias("attributed_share"),
        (attributed > F.col("total_credits")).alias("overlap_warning"),
    )


# Figures that no recorded field can support, and what would unblock them.
NEVER_AVAILABLE = (
    ("W13", "the reasoning-effort setting is not recorded", "record the setting with the tokens"),
    ("W14", "no per-call cost and no subagent call graph", "per-call attribution and a call graph"),
    ("PD1", "git has no review times", "review events from the forge"),
    ("PD6", "git has no reviewers", "review events from the forge"),
    ("review-effort", "git has no review times", "review events from the forge"),
    ("incident-linkage", "incidents are not in git", "an incident feed by commit range"),
    ("reviewer-concentration", "git has no reviewers", "review events from the forge"),
    ("chat-abandonment", "a session ends the same way whatever its outcome", "an outcome signal"),
    ("developer-satisfaction", "not observable in telemetry", "a separate survey"),
    ("otel-tool-definitions", "spans carry no tool-definition tokens", "a numeric span attribute"),
    ("otel-cost-centres", "spans carry no prompt breakdown", "token counts per cost centre"),
)


def coverage_report(corpus: Corpus) -> DataFrame:
    """What could not be measured in this corpus, and why."""
    spark = corpus.request.sparkSession
    fixed = spark.createDataFrame(NEVER_AVAILABLE, "subject string, reason string, unblocked_by string")
    rows = []
    if corpus.commit_file is None:
        fixed = fixed.unionByName(
            spark.createDataFrame(
                [("W7", "no commit history was supplied", "export the repository's log")], fixed.schema
            )
        )
    else:
        rows.append(
            survival_coverage(corpus)
            .where(~F.col("sufficient"))
            .select(
                F.lit("W7").alias("subject"),
                F.when(F.col("judged_requests") < 20, "too few judged requests")
                .otherwise("history covers too few edited files")
                .alias("reason"),
                F.lit("the repository the edits belong to").alias("unblocked_by"),
            )
        )
    if corpus.question is None:
        fixed = fixed.unionByName(
            spark.createDataFrame(
                [("W8", "no organisation-wide questions were supplied", "an organisation roll-up")],
                fixed.schema,
            )
        )
    priced = centre_tokens(corpus, "Files").where(F.col("tokens") > 0)
    keys = [*corpus.by, "request_id"]
    references = corpus.content_reference.join(
        priced.select(*keys).withColumn("_priced", F.lit(1)), keys, "left"
    ).agg(F.count(F.lit(1)).alias("seen"), F.count("_priced").alias("priceable"))
    rows.append(
        references.where((F.col("seen") > 0) & (F.col("priceable") < 50)).select(
            F.lit("W11").alias("subject"),
            F.lit("too few references on requests with a Files cost").alias("reason"),
            F.lit("a decomposed Files cost on every request").alias("unblocked_by"),
        )
    )
    out = fixed
    for row in rows:
        out = out.unionByName(row)
    return out


def first_reads(corpus: Corpus) -> DataFrame:
    """The first read of every file in every session."""
    keys = [*corpus.by, "session_id", "file_hash"]
    return corpus.read_calls.groupBy(*keys).agg(
        F.min_by(F.struct("chars", "whole_file"), "place").alias("_first")
    ).select(*keys, "_first.chars", "_first.whole_file")


def residual_probes(corpus: Corpus) -> DataFrame:
    """What would remain after the usual remedies, per probe."""
    by = corpus.by
    out = first_reads(corpus).groupBy(*by).agg(
        F.avg(F.col("whole_file").cast("double")).alias("value"), F.count(F.lit(1)).alias("sample_size")
    ).select(*by, F.lit("w2-whole-file-first-reads").alias("probe"), "value", "sample_size",
             F.lit(0.35).alias("threshold"), F.lit(30).alias("minimum_sample"))
    measured = corpus.tool_call.where(F.col("result_chars").isNotNull())
    norms = rank_pick(measured, "result_chars", {"median": med_upper}, [*by, "name"], "calls").where(
        (F.col("calls") >= 10) & (F.col("median") > 0)
    )
    over = (F.col("result_chars") > F.col("median") * 3) & (F.col("result_chars") <= 16_000)
    oversize = measured.join(norms.select(*by, "name", "median"), [*by, "name"], "left").groupBy(*by).agg(
        F.avg(F.coalesce(over, F.lit(False)).cast("double")).alias("value"),
        F.count(F.lit(1)).alias("sample_size"),
    )
    out = out.unionByName(
        oversize.select(*by, F.lit("w3-sub-cap-oversize").alias("probe"), "value", "sample_size",
                        F.lit(0.1).alias("threshold"), F.lit(50).alias("minimum_sample"))
    )
    if corpus.question is not None:
        out = out.unionByName(
            duplication_summary(corpus.question, by).select(
                *by, F.lit("w8-cross-developer-repeats").alias("probe"),
                F.col("redundant_share").alias("value"), F.col("questions_seen").alias("sample_size"),
                F.lit(0.05).alias("threshold"), F.lit(200).alias("minimum_sample"))
        )
    keys = [*by, "session_id", "file_hash"]
    shown = corpus.content_reference.join(
        corpus.request.select(*by, "request_id", "session_id"), [*by, "request_id"]
    ).join(opened_files(corpus).withColumn("_opened", F.lit(1)), keys, "left")
    out = out.unionByName(
        shown.groupBy(*by).agg(
            F.avg(F.col("_opened").isNull().cast("double")).alias("value"),
            F.count(F.lit(1)).alias("sample_size"),
        ).select(*by, F.lit("w11-unopened-references").alias("probe"), "value", "sample_size",
                 F.lit(0.4).alias("threshold"), F.lit(50).alias("minimum_sample"))
    )
    enough = F.col("sample_size") >= F.col("minimum_sample")
    return out.withColumn("sufficient", enough).withColumn(
        "exceeded", enough & (F.col("value") > F.col("threshold"))
    )


def spend_snapshot(corpus: Corpus, today: str, allowance: float | None) -> DataFrame:
    """One row for a status display: month, workspace, longest session, top six models."""
    days = L.spend_by_day(corpus.request, corpus.card)
    forecast = B.forecast_budget(days, today, F.lit(allowance))
    limit, spent = F.col("monthly_allowance"), F.col("month_to_date_credits")
    month = forecast.select(
        "*",
        F.when(limit.isNotNull(), F.greatest(F.lit(0.0), limit - spent)).alias("remaining_credits"),
        F.when(limit != 0, spent / limit).alias("percent_used"),
        credits_to_usd(
            F.when(limit.isNull(), spent).otherwise(F.greatest(F.lit(0.0), spent - limit))
        ).alias("incremental_usd"),
    )
    totals = L.ledger_totals(corpus.request, corpus.card).select(
        F.col("credits").alias("all_time_credits"),
        F.col("request_count").alias("requests"),
        measured_percent(F.col("measured_credits"), F.col("credits")).alias("measured_percent"),
        provenance_kind(F.col("measured_credits"), F.col("modelled_credits")).alias("provenance"),
    )
    active = days.agg(
        F.count(F.lit(1)).alias("active_days"),
        F.coalesce(F.sum(F.when(F.col("day") == F.lit(today).cast("date"), F.col("credits"))), F.lit(0.0)).alias("today_credits"),
    )
    longest = B.longest_session(corpus.request).select("session_id")
    session = B.next_turn_projection(corpus.priced).join(longest, "session_id", "left_semi").select(
        F.col("turns").alias("session_turns"),
        F.col("session_credits").alias("session_credits"),
        F.col("next_turn_credits"),
    )
    models = L.spend_by_model(corpus.request, corpus.card).limit(6).agg(
        F.sort_array(F.collect_list(F.struct("credits", "model")), asc=False).alias("_m")
    ).select(F.transform("_m", lambda m: m["model"]).alias("top_models"))
    out = month
    for part in (totals, active, session, models):
        out = attach(out, part)
    return out


def monthly_report(corpus: Corpus, month: str, allowance: float | None) -> dict[str, DataFrame]:
    """Tables of one month. The rate card and the waste section look at the whole corpus."""
    first, last = month_bounds(F.lit(month))
    inside = corpus.request.where(day_key(F.col("ts")).between(first, last))
    days = L.spend_by_day(inside, corpus.card)
    models = L.spend_by_model(inside, corpus.card)
    year, number = (int(part) for part in month.split("-"))
    end = f"{month}-{monthrange(year, number)[1]:02d}"
    longest = B.longest_session(corpus.request).select("session_id")
    return {
        "totals": L.ledger_totals(inside, corpus.card),
        "by_day": days,
        "by_model": models,
        "by_cost_centre": L.spend_by_cost_centre(corpus.cost_centre, inside, corpus.card),
        "budget": B.forecast_budget(days, end, F.lit(allowance)),
        "waste": waste_findings(corpus),
        "advice": B.model_substitution(models, corpus.card),
        "session": B.next_turn_projection(corpus.priced).join(longest, "session_id", "left_semi"),
    }


def build_contribution(corpus: Corpus) -> DataFrame:
    """Monthly aggregate per calendar month: totals, model mix and session-length histogram."""
    month = F.date_format(day_key(F.col("ts")), "yyyy-MM").alias("period")
    requests = corpus.request.withColumn("period", month)
    keyed = [*corpus.by, "period"]
    card = corpus.card
    priced = L.spend(requests, card, {"period": F.col("period"), "model_id": F.col("model")}, corpus.by)
    totals = priced.groupBy(*keyed).agg(
        F.sum("credits").alias("total_credits"),
        F.sum("measured_credits").alias("measured_credits"),
        F.sum("modelled_credits").alias("modelled_credits"),
        F.sum("request_count").alias("request_count"),
        F.sort_array(
            F.collect_list(F.struct(F.col("model_id").alias("model"), "credits", F.col("request_count").alias("requests")))
        ).alias("by_model"),
    )
    active = requests.groupBy(*keyed).agg(F.countDistinct(day_key(F.col("ts"))).alias("active_days"))
    sessions = L.spend(requests, card, {"period": F.col("period"), "session_id": F.col("session_id")}, corpus.by)
    lengths = (
        sessions.groupBy(*keyed, length_bucket(F.col("request_count")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("credits").alias("credits"))
        .groupBy(*keyed)
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "sessions", "credits"))).alias("session_lengths"))
    )
    return totals.join(active, keyed).join(lengths, keyed)

