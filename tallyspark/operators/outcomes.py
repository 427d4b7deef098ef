"""Durability of committed work, effort, and work displaced rather than saved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running
from ..functions.quantiles import med_mid
from ..functions.scalars import sample_confidence
from ..session import attach, written
from .survival import kaplan_meier, survival_at

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
HORIZON_DAYS = 30
SURVIVAL_THRESHOLD = 0.5
SESSION_GAP_MS = 120 * 60_000
FIRST_COMMIT_HOURS = 0.5
WINDOW_DAYS = 90
MIN_CHANGES = 20

_EVENTS = "ts long, sha string, phase int, lines long, deleted_ts long"


def file_changes(commits: DataFrame, commit_files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Changed files of non-merge commits with the commit's time."""
    heads = commits.where(~F.col("is_merge")).select(*by, "sha", "ts")
    return commit_files.join(heads, [*by, "sha"])


def _newest_first(keys: Sequence[str]):
    """Matcher over partitions sorted by (keys, chunk, time).

    Deletions (phase 0) eat the newest added lines (phase 1) still standing in their
    chunk. Output keeps what stays unmatched and adds matches (phase 2) with the
    addition's sha and both times. Only the standing lines of one chunk are held.
    """
    width = len(keys)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, standing = None, []

        def leftovers() -> list[tuple]:
            return [(*current[:width], ts, sha, 1, lines, None) for ts, sha, lines in standing]

        columns = [*keys, "ts", "sha", "phase", "lines", "deleted_ts"]
        for batch in batches:
            out: list[tuple] = []
            order = [batch[c].tolist() for c in (*keys, "_chunk", "ts", "sha", "phase", "lines")]
            for *group, ts, sha, phase, lines in zip(*order):
                if group != current:
                    out.extend(leftovers())
                    current, standing = group, []
                if phase == 1:
                    standing.append([ts, sha, lines])
                    continue
                while lines > 0 and standing:
                    newest = standing[-1]
                    eaten = min(newest[2], lines)
                    out.append((*group[:width], newest[0], newest[1], 2, eaten, ts))
                    newest[2] -= eaten
                    lines -= eaten
                    if newest[2] == 0:
                        standing.pop()
                if lines > 0:
                    out.append((*group[:width], ts, sha, 0, lines, None))
            yield pd.DataFrame(out, columns=columns).astype({"deleted_ts": "Int64"})
        if standing:
            yield pd.DataFrame(leftovers(), columns=columns).astype({"deleted_ts": "Int64"})

    return match


def attribute_deletions(
    changes: DataFrame, by: Sequence[str] = (), horizon_days: int = HORIZON_DAYS
) -> DataFrame:
    """Which added lines each deletion removed, newest first, within the horizon.

    `changes` has path_hash, sha, ts, added and deleted. Matching inside one day leaves
    deletions that reach further back and additions still standing; matching those
    leftovers inside one horizon-long chunk, and then across one chunk boundary, gives
    the same result as one pass over the file: matched pairs nest, and a deletion within
    the horizon reaches at most the chunk before its own. So no file is ever gathered
    whole, however hot it is.
    """
    by = list(by)
    keys = [*by, "path_hash"]
    phases = F.array(
        F.struct(F.lit(0).alias("phase"), F.col("deleted").cast("long").alias("lines")),
        F.struct(F.lit(1).alias("phase"), F.col("added").cast("long").alias("lines")),
    )
    events = (
        changes.select(*keys, "sha", "ts", F.explode(phases).alias("e"))
        .select(*keys, "ts", "sha", "e.*", F.lit(None).cast("long").alias("deleted_ts"))
        .where(F.col("lines") > 0)
    )
    horizon_ms = horizon_days * DAY_MS
    chunk = F.floor(F.col("ts") / horizon_ms)
    groups = (
        F.floor(F.col("ts") / DAY_MS),
        chunk,
        # Additions move to the next chunk, where deletions of that chunk find them.
        F.when(F.col("phase") == 1, chunk + 1).otherwise(chunk),
    )
    types = dict(changes.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys]) + ", " + _EVENTS
    matches = None
    for group in groups:
        # Only a group in which an addition comes before a deletion can have a match; the others, nearly all, pass as they are.
        together = Window.partitionBy(*keys, "_chunk")
        at = F.struct("ts", "sha")
        busy = F.min(F.when(F.col("phase") == 1, at)).over(together) < F.max(F.when(F.col("phase") == 0, at)).over(together)
        grouped = events.withColumn("_chunk", group).repartition(*keys, "_chunk").withColumn("_busy", F.coalesce(busy, F.lit(False)))
        sorted_chunks = grouped.where("_busy").drop("_busy").sortWithinPartitions(*keys, "_chunk", "ts", "sha", "phase")
        quiet = grouped.where("NOT _busy").select(events.columns)
        # Kept in shared storage: the matches and the next pass both read it.
        result = written(sorted_chunks.mapInPandas(_newest_first(keys), schema).unionByName(quiet))
        found = result.where(F.col("phase") == 2)
        matches = found if matches is None else matches.unionByName(found)
        events = result.where(F.col("phase") < 2)
    return matches.where(F.col("deleted_ts") - F.col("ts") <= horizon_ms).select(
        *keys,
        F.col("sha").alias("change_id"),
        F.col("ts").alias("added_ts"),
        "deleted_ts",
        "lines",
    )


def survival_observations(
    changes: DataFrame,
    matches: DataFrame,
    now_ms: int,
    by: Sequence[str] = (),
    horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    """Added lines as (duration in days, event, weight): deleted, or censored now."""
    by = list(by)
    keys = [*by, "path_hash", "change_id"]
    events = matches.groupBy(
        *by, ((F.col("deleted_ts") - F.col("added_ts")) / DAY_MS).alias("duration")
    ).agg(F.sum("lines").cast("double").alias("weight"))
    gone = matches.groupBy(*keys).agg(F.sum("lines").alias("gone"))
    standing = changes.select(
        *by, "path_hash", F.col("sha").alias("change_id"), "ts", "added"
    ).join(gone, keys, "left")
    left = F.col("added") - F.coalesce("gone", F.lit(0))
    age = F.least((F.lit(now_ms) - F.col("ts")) / DAY_MS, F.lit(float(horizon_days)))
    censored = (
        standing.where(left > 0)
        .groupBy(*by, age.alias("duration"))
        .agg(F.sum(left).cast("double").alias("weight"))
    )
    return events.withColumn("event", F.lit(True)).unionByName(
        censored.withColumn("event", F.lit(False))
    )


def measure_durability(
    commits: DataFrame,
    changes: DataFrame,
    matches: DataFrame,
    now_ms: int,
    by: Sequence[str] = (),
    horizon_days: int = HORIZON_DAYS,
    threshold: float = SURVIVAL_THRESHOLD,
) -> DataFrame:
    """Surviving lines and the durability verdict of every non-merge commit.

    `durable` is null while the change has not been observed for the whole horizon.
    """
    by = list(by)
    per_change = changes.groupBy(*by, "sha").agg(
        F.sum("added").alias("lines_added"),
        F.sum("deleted").alias("lines_deleted"),
        F.count(F.lit(1)).alias("files_touched"),
    )
    churn = matches.groupBy(*by, F.col("change_id").alias("sha")).agg(F.sum("lines").alias("churn"))
    reverts = (
        commits.where(F.col("reverts_sha").isNotNull())
        .select(*by, F.col("reverts_sha").alias("sha"))
        .distinct()
        .withColumn("_reverted", F.lit(True))
    )
    rows = (
        commits.where(~F.col("is_merge"))
        .select(*by, "sha", "author_id", "ts", "pull_request")
        .join(per_change, [*by, "sha"], "left")
        .join(churn, [*by, "sha"], "left")
        .join(reverts, [*by, "sha"], "left")
    )
    zero = F.lit(0)
    rows = rows.select(
        *by,
        F.col("sha").alias("change_id"),
        "author_id",
        "ts",
        "pull_request",
        *[F.coalesce(c, zero).alias(c) for c in ("lines_added", "lines_deleted", "files_touched")],
        F.least(F.coalesce("churn", zero), F.coalesce("lines_added", zero)).alias("lines_churned"),
        F.coalesce("_reverted", F.lit(False)).alias("reverted"),
        (F.lit(now_ms) - F.col("ts") >= horizon_days * DAY_MS).alias("fully_observed"),
    ).withColumn("lines_surviving", F.col("lines_added") - F.col("lines_churned"))
    fraction = F.when(
        F.col("lines_added") > 0, F.col("lines_surviving") / F.col("lines_added")
    ).otherwise(F.lit(1.0))
    return rows.withColumn("surviving_fraction", fraction).withColumn(
        "durable",
        F.when(
            F.col("fully_observed"),
            ~F.col("reverted") & (F.col("surviving_fraction") >= threshold),
        ),
    )


def summarise_durability(durability: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = durability.groupBy(*by).agg(
        F.count(F.lit(1)).alias("changes"),
        F.count(F.when(F.col("durable"), 1)).alias("durable"),
        F.count(F.when(~F.col("durable"), 1)).alias("not_durable"),
        F.count(F.when(F.col("durable").isNull(), 1)).alias("unknown"),
        F.coalesce(F.sum(F.when(F.col("fully_observed"), F.col("lines_surviving"))), F.lit(0)).alias(
            "durable_line_equivalents"
        ),
    )
    decided = F.col("durable") + F.col("not_durable")
    return counts.withColumn("durable_rate", F.when(decided > 0, F.col("durable") / decided))


def author_hours(commits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hours behind every non-merge commit.

    A commit within two hours of its author's previous one counts the time in between,
    any other counts half an hour.
    """
    work = commits.where(~F.col("is_merge"))
    placed = running(
        work, [*by, "author_id"], F.floor(F.col("ts") / DAY_MS), [F.col("ts"), F.col("sha")],
        {"_previous": ("max", F.col("ts"))}, exclusive=True,
    )
    gap = F.col("ts") - F.col("_previous")
    hours = F.when(gap <= SESSION_GAP_MS, gap / HOUR_MS).otherwise(F.lit(FIRST_COMMIT_HOURS))
    return placed.withColumn("hours", hours).drop("_previous")


def review_latencies(commits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hours from the newest merged-in parent to its merge commit."""
    by = list(by)
    tips = commits.where(F.col("is_merge")).select(
        *by,
        "sha",
        F.col("ts").alias("merged_ts"),
        F.explode(F.expr("slice(parents, 2, greatest(size(parents), 1))")).alias("parent"),
    )
    known = commits.select(*by, F.col("sha").alias("parent"), F.col("ts").alias("parent_ts"))
    newest = tips.join(known, [*by, "parent"]).groupBy(*by, "sha").agg(
        F.max("merged_ts").alias("merged_ts"), F.max("parent_ts").alias("parent_ts")
    )
    hours = (F.col("merged_ts") - F.col("parent_ts")) / HOUR_MS
    return newest.select(*by, "sha", hours.alias("latency_hours")).where(F.col("latency_hours") >= 0)


def familiarity(commits: DataFrame, commit_files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of a commit's files that its author had touched in an earlier commit."""
    by = list(by)
    place = F.struct("ts", "sha")
    touched = commit_files.select(*by, "sha", "path_hash").join(
        commits.where(~F.col("is_merge")).select(*by, "sha", "author_id", "ts"), [*by, "sha"]
    )
    first = touched.groupBy(*by, "author_id", "path_hash").agg(F.min(place).alias("first"))
    known = (F.col("first") < place).cast("double")
    return (
        touched.join(first, [*by, "author_id", "path_hash"])
        .groupBy(*by, "sha")
        .agg(F.avg(known).alias("familiarity"))
    )


def decompose_effort(
    commits: DataFrame, commit_files: DataFrame, durability: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Authoring, rework and failure hours per tenant."""
    by = list(by)
    lines = commit_files.groupBy(*by, "sha").agg(
        F.sum(F.col("added") + F.col("deleted")).alias("touched"),
        F.sum("deleted").alias("rewritten"),
    )
    judged = durability.select(*by, F.col("change_id").alias("sha")).withColumn("_judged", F.lit(1.0))
    rows = (
        author_hours(commits, by)
        .join(lines, [*by, "sha"], "left")
        .join(judged, [*by, "sha"], "left")
        .where(F.col("hours") > 0)
    )
    share = F.when(
        (F.col("touched") > 0) & (F.col("rewritten") > 0),
        F.least(F.lit(1.0), F.col("rewritten") / F.col("touched"))
        * F.coalesce("_judged", F.lit(0.5)),
    ).otherwise(F.lit(0.0))
    failing = F.col("reverts_sha").isNotNull()
    hours = F.col("hours")
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(failing, 0.0).otherwise(hours * (1 - share))).alias("author_hours"),
        F.sum(F.when(failing, 0.0).otherwise(hours * share)).alias("rework_hours"),
        F.sum(F.when(failing, hours).otherwise(0.0)).alias("failure_hours"),
    )
    total = F.col("author_hours") + F.col("rework_hours") + F.col("failure_hours")
    return sums.withColumn("measurable_hours", total).withColumn(
        "rework_ratio",
        F.when(
            F.col("author_hours") > 0,
            (F.col("rework_hours") + F.col("failure_hours")) / F.col("author_hours"),
        ),
    )


def detect_displacement(
    commits: DataFrame,
    commit_files: DataFrame,
    durability: DataFrame,
    now_ms: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Signs that work moved instead of shrinking, last 90 days against the 90 before.

    One row per tenant: the four deltas (null when a sign did not fire), the change
    counts, and the composite alarm. A fall in survival stands both for itself and for
    the throughput side of the alarm, as published.
    """
    by = list(by)
    span = WINDOW_DAYS * DAY_MS
    window = F.when((F.col("ts") >= now_ms - span) & (F.col("ts") < now_ms), "recent").when(
        (F.col("ts") >= now_ms - 2 * span) & (F.col("ts") < now_ms - span), "prior"
    )
    keyed = [*by, "window"]
    recent_commits = commits.withColumn("window", window).where(F.col("window").isNotNull())
    recent_changes = durability.withColumn("window", window).where(F.col("window").isNotNull())
    files = commit_files.join(recent_commits.select(*keyed, "sha"), [*by, "sha"])
    observed = F.col("fully_observed") & (F.col("lines_added") > 0)
    facts = recent_changes.groupBy(*keyed).agg(
        F.count(F.lit(1)).alias("changes"),
        F.avg(F.when(observed, F.col("surviving_fraction"))).alias("survival"),
        F.avg("lines_added").alias("size"),
        F.avg(F.col("reverted").cast("double")).alias("revert_rate"),
    )
    latency = review_latencies(recent_commits, keyed).groupBy(*keyed).agg(
        F.avg("latency_hours").alias("latency")
    )
    counts = recent_commits.groupBy(*keyed).agg(F.count(F.lit(1)).alias("commits"))
    effort = decompose_effort(recent_commits, files, recent_changes, keyed).select(
        *keyed, "rework_ratio"
    )
    both = facts
    for part in (latency, counts, effort):
        both = both.join(part, keyed, "left")
    names = ["changes", "commits", "survival", "size", "revert_rate", "latency", "rework_ratio"]
    side = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}")
    row = both.groupBy(*by).agg(*[side(w, c) for w in ("recent", "prior") for c in names])
    c = F.col
    enough = (c("recent_changes") >= MIN_CHANGES) & (c("prior_changes") >= MIN_CHANGES)
    positive = lambda x: F.when(enough & (x > 0), x)
    size_growth = c("recent_size") / c("prior_size") - 1
    latency_growth = c("recent_latency") / c("prior_latency") - 1
    blast = F.when(
        enough & (c("prior_size") != 0) & (c("prior_latency") != 0)
        & (size_growth > 0.1) & (latency_growth < size_growth),
        size_growth - latency_growth,
    )
    changes = c("recent_changes") + c("prior_changes")
    out = row.select(
        *by,
        "recent_changes",
        "prior_changes",
        positive(c("prior_survival") - c("recent_survival")).alias("pd2"),
        blast.alias("pd3"),
        positive(c("recent_rework_ratio") - c("prior_rework_ratio")).alias("pd4"),
        positive(c("recent_revert_rate") - c("prior_revert_rate")).alias("pd5"),
        sample_confidence(changes, 100).alias("pd2_confidence"),
        sample_confidence(c("recent_commits"), 200).alias("pd3_confidence"),
        sample_confidence(c("recent_commits"), 200).alias("pd4_confidence"),
        sample_confidence(changes, 200).alias("pd5_confidence"),
    )
    alarm = (
        c("pd2").isNotNull() & (c("recent_changes") > c("prior_changes")) & c("pd4").isNotNull()
    )
    return out.withColumn("composite_alarm", alarm)


def outcome_report(
    commits: DataFrame, commit_files: DataFrame, now_ms: int, by: Sequence[str] = ()
) -> DataFrame:
    """Durability, survival at the horizon, effort and hours per durable change."""
    by = list(by)
    changes = file_changes(commits, commit_files, by)
    matches = attribute_deletions(changes, by)
    durability = measure_durability(commits, changes, matches, now_ms, by)
    curve = kaplan_meier(survival_observations(changes, matches, now_ms, by), by)
    at_end = survival_at(curve, HORIZON_DAYS, by)
    effort = decompose_effort(commits, commit_files, durability, by)
    people = commits.groupBy(*by).agg(
        F.countDistinct("author_id").alias("authors"),
        F.min("ts").alias("window_from"),
        F.max("ts").alias("window_to"),
    )
    deleted = changes.groupBy(*by).agg(F.sum("deleted").alias("deletions"))
    attributed = matches.groupBy(*by).agg(F.sum("lines").alias("attributed"))
    out = summarise_durability(durability, by)
    for part in (
        people,
        at_end.select(*by, F.when(F.col("estimable"), F.col("survival")).alias("survival_at_horizon")),
        effort,
        med_mid(review_latencies(commits, by), "latency_hours", "median_review_latency_hours", by),
        deleted,
        attributed,
    ):
        out = attach(out, part, by)
    coverage = F.when(
        F.col("deletions") > 0, F.coalesce("attributed", F.lit(0)) / F.col("deletions")
    ).otherwise(F.lit(0.0))
    return out.withColumn("attribution_coverage", coverage).withColumn(
        "hours_per_durable_change",
        F.when(F.col("durable") > 0, F.col("measurable_hours") / F.col("durable")),
    )


def build_panel(
    durability: DataFrame,
    unit: Column,
    outcome: str = "survival",
    period_days: int = 7,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean outcome per unit and period over fully observed changes; empty cells drop out."""
    observed = F.col("fully_observed") & (F.col("lines_added") > 0)
    measured = "surviving_fraction" if outcome == "survival" else "lines_added"
    value = F.avg(F.when(observed, F.col(measured)))
    return (
        durability.groupBy(
            *by,
            unit.alias("unit"),
            F.floor(F.col("ts") / (period_days * DAY_MS)).alias("period"),
        )
        .agg(value.cast("double").alias("outcome"), F.count(F.lit(1)).alias("changes"))
        .where(F.col("outcome").isNotNull())
    )
