"""Counterfactual replay of recorded requests under a policy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running, value_bucket
from ..functions.quantiles import q_ceil, rank_pick
from ..functions.scalars import (
    CHARS_PER_TOKEN,
    band_of,
    damp,
    match_tool_pattern,
    realisation,
    server_of,
    tokens_from_chars,
)
from ..session import attach, join_dimension, materialise
from .budget import PLAN_ALLOWANCES
from .corpus import Corpus
from .pricing import cheapest_measured, find_rates
from .waste.complexity import complexity_bands, complexity_scores
from .waste.detectors import stale_turns

# Tier of each lever.
TIERS = {
    "model-routing": "A",
    "tool-trim": "A",
    "payload-cap": "B",
    "loop-cap": "B",
    "session-hygiene": "C",
    "dedupe-reads": "B",
}
REGRET_SAMPLE = 10
MIN_SAMPLE = 20


@dataclass(frozen=True)
class Route:
    to: str
    complexity: str | None = None
    max_rounds: int | None = None


@dataclass(frozen=True)
class Policy:
    """What to change. A field left at None switches its lever off."""

    route: Sequence[Route] = ()
    default_model: str | None = None
    utility_model: str | None = None
    allow_mcp: Sequence[str] | None = None
    deny_tools: Sequence[str] | None = None
    max_result_tokens: int | None = None
    max_rounds: int | None = None
    nudge_after_turns: int | None = None
    dedupe_reads: bool = False
    notes: dict[str, str] = field(default_factory=dict)

    @property
    def targets(self) -> list[str]:
        named = [rule.to for rule in self.route]
        return sorted({*named, *([self.default_model] if self.default_model else [])})

    def band_for(self, target: str) -> str:
        """Band of the first rule that routes to `target`; 'low' when it names none."""
        first = next((rule for rule in self.route if rule.to == target), None)
        return first.complexity if first is not None and first.complexity else "low"


def _changes(
    rows: DataFrame, by: Sequence[str], lever: str, token: Column, rate: Column | None = None
) -> DataFrame:
    return rows.select(
        *by,
        "request_id",
        F.lit(lever).alias("lever"),
        F.lit(TIERS[lever]).alias("tier"),
        token.cast("double").alias("token_scale"),
        (F.lit(1.0) if rate is None else rate).cast("double").alias("rate_scale"),
    )


def banded_requests(corpus: Corpus) -> DataFrame:
    """Requests with their complexity band and round count."""
    keys = [*corpus.by, "request_id"]
    scores = complexity_scores(corpus)
    if corpus.shared:
        score = ((F.coalesce("points", F.lit(0)) + F.col("output_tokens")) / 500).alias("score")
        rows = corpus.facts.select(*keys, "model", "prompt_tokens", score, "rounds")
    else:
        rows = (
            corpus.request.select(*keys, "model", "prompt_tokens")
            .join(scores, keys)
            .join(corpus.round_counts, keys, "left")
        )
    rows = rows.withColumn("rounds", F.coalesce("rounds", F.lit(0)))
    # One row per tenant, written once: regret and routing both look at it.
    bands = materialise(complexity_bands(corpus, scores)).select(*corpus.by, "low_ceiling", "medium_ceiling")
    rows = attach(rows, bands, corpus.by)
    return rows.withColumn(
        "band", band_of(F.col("score"), F.col("low_ceiling"), F.col("medium_ceiling"))
    )


def measure_regret(corpus: Corpus, policy: Policy, banded: DataFrame | None = None) -> DataFrame:
    """Extra rounds a target model needs in its band, against all other models there.

    One row per tenant and target; `regret` is null with fewer than ten requests on
    either side or no rounds to compare with.
    """
    by = corpus.by
    banded = banded_requests(corpus) if banded is None else banded
    entries = []
    for target in policy.targets:
        here = F.col("band") == policy.band_for(target)
        on, off = here & (F.col("model") == target), here & (F.col("model") != target)
        entries.append(
            F.struct(
                F.lit(target).alias("target"),
                F.lit(policy.band_for(target)).alias("band"),
                F.count(F.when(on, 1)).alias("target_samples"),
                F.count(F.when(off, 1)).alias("origin_samples"),
                F.avg(F.when(on, F.col("rounds"))).alias("target_rounds"),
                F.avg(F.when(off, F.col("rounds"))).alias("origin_rounds"),
            )
        )
    rows = banded.groupBy(*by).agg(F.array(*entries).alias("_t")).select(
        *by, F.explode("_t").alias("_t")
    ).select(*by, "_t.*")
    enough = (
        (F.col("target_samples") >= REGRET_SAMPLE)
        & (F.col("origin_samples") >= REGRET_SAMPLE)
        & (F.col("origin_rounds") > 0)
    )
    ratio = F.greatest(F.lit(0.0), F.col("target_rounds") / F.col("origin_rounds") - 1)
    return rows.withColumn("regret", F.when(enough, ratio))


def model_routing(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """Reprice requests at the model the first matching rule names."""
    if not policy.targets:
        return None
    by = corpus.by
    banded = banded_requests(corpus)
    choice = None
    for rule in policy.route:
        fits = F.lit(True)
        if rule.complexity is not None:
            fits = fits & (F.col("band") == rule.complexity)
        if rule.max_rounds is not None:
            fits = fits & (F.col("rounds") <= rule.max_rounds)
        choice = F.when(fits, rule.to) if choice is None else choice.when(fits, rule.to)
    fallback = F.lit(policy.default_model)
    target = fallback if choice is None else choice.otherwise(fallback)
    wanted = F.explode(F.array(*[F.lit(t) for t in policy.targets]))
    named = corpus.card.select(*by).distinct() if by else corpus.card.limit(1).select()
    found = find_rates(named.select(*by, wanted.alias("model")), corpus.card, by)
    measured = found.where(F.col("provenance") == "measured")
    # Regret and rate come to one row per tenant and target.
    regret = measure_regret(corpus, policy, banded).select(*by, "target", "regret")
    targets = materialise(
        measured.select(*by, F.col("model").alias("target"), F.col("rate").alias("to_rate")).join(
            regret, [*by, "target"], "left"
        )
    )
    origins = corpus.card.select(*by, "model", F.col("rate").alias("from_rate"))
    moved = banded.withColumn("target", target).where(
        F.col("target").isNotNull() & (F.col("target") != F.col("model"))
    )
    moved = join_dimension(moved, origins, [*by, "model"])
    moved = join_dimension(moved, targets, [*by, "target"], "inner").where(F.col("from_rate") > 0)
    return _changes(
        moved, by, "model-routing",
        F.lit(1.0) + F.coalesce("regret", F.lit(0.0)), F.col("to_rate") / F.col("from_rate"),
    )


def removed_tools(corpus: Corpus, policy: Policy) -> DataFrame:
    """Observed tools with their calls and whether the policy removes them."""
    tools = corpus.tool_call.groupBy(*corpus.by, "name").agg(F.count(F.lit(1)).alias("calls"))
    server = server_of(F.col("name"))
    bare = F.regexp_replace(server, "^mcp:", "")
    removed = F.lit(False)
    if policy.allow_mcp is not None:
        removed = removed | ((server != "built-in") & ~bare.isin(*policy.allow_mcp))
    for pattern in policy.deny_tools or ():
        removed = removed | match_tool_pattern(F.col("name"), pattern)
    return tools.withColumn("removed", removed)


def tool_trim(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """Free the removed tools' share of every request's tool-definition tokens."""
    if policy.allow_mcp is None and policy.deny_tools is None:
        return None
    by = corpus.by
    share = removed_tools(corpus, policy).groupBy(*by).agg(
        (F.count(F.when(F.col("removed"), 1)) / F.count(F.lit(1))).alias("share")
    )
    rows = attach(corpus.requests_with("Tool Definitions"), share, by)
    freed = F.col("tokens") * F.col("share")
    rows = rows.where((F.col("prompt_tokens") > 0) & (freed > 0))
    scale = F.greatest(F.lit(0.0), (F.col("prompt_tokens") - freed) / F.col("prompt_tokens"))
    return _changes(rows, by, "tool-trim", scale)


def _clamped(corpus: Corpus, chars: DataFrame, lever: str) -> DataFrame:
    """Remove characters, at most the request's own Tool Results tokens.

    Requests without that cost centre are left out by the inner join.
    """
    keys = [*corpus.by, "request_id"]
    rows = corpus.requests_with("Tool Results").join(chars, keys)
    gone = F.least(tokens_from_chars(F.col("chars")), F.col("tokens"))
    rows = rows.where((F.col("prompt_tokens") > 0) & (F.col("chars") > 0) & (gone > 0))
    scale = F.greatest(F.lit(0.0), (F.col("prompt_tokens") - gone) / F.col("prompt_tokens"))
    return _changes(rows, corpus.by, lever, scale)


def payload_cap(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """Cut tool results at the cap."""
    if policy.max_result_tokens is None:
        return None
    over = F.col("result_chars") - policy.max_result_tokens * CHARS_PER_TOKEN
    chars = (
        corpus.tool_call.where(over > 0)
        .groupBy(*corpus.by, "request_id")
        .agg(F.sum(over).alias("chars"))
    )
    return _clamped(corpus, chars, "payload-cap")


def loop_cap(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """Scale requests past the round cap down to it."""
    if policy.max_rounds is None:
        return None
    deep = corpus.round_counts.where(F.col("rounds") > policy.max_rounds)
    return _changes(deep, corpus.by, "loop-cap", F.lit(policy.max_rounds) / F.col("rounds"))


def loop_cap_risk(corpus: Corpus, policy: Policy) -> DataFrame:
    """Capped requests, how many of them had finished an edit, and the deepest."""
    keys = [*corpus.by, "request_id"]
    finished = (
        corpus.edit.where(F.col("done") & (F.col("edit_count") > 0)).select(*keys).distinct()
    )
    deep = corpus.round_counts.where(F.col("rounds") > policy.max_rounds)
    return (
        deep.join(finished.withColumn("finished", F.lit(True)), keys, "left")
        .groupBy(*corpus.by)
        .agg(
            F.count(F.lit(1)).alias("capped"),
            F.count("finished").alias("capped_with_edit"),
            F.max("rounds").alias("deepest"),
        )
    )


def session_hygiene(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """After the nudge, prompts fall back to the session's own opening size."""
    if policy.nudge_after_turns is None:
        return None
    late = stale_turns(corpus, policy.nudge_after_turns).where(
        F.col("prompt_tokens") > F.col("baseline")
    )
    return _changes(late, corpus.by, "session-hygiene", F.col("baseline") / F.col("prompt_tokens"))


def dedupe_reads(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """Drop re-read characters."""
    if not policy.dedupe_reads:
        return None
    chars = (
        corpus.rereads
        .where("duplicate")
        .groupBy(*corpus.by, "request_id")
        .agg(F.sum("chars").alias("chars"))
    )
    return _clamped(corpus, chars, "dedupe-reads")


LEVERS = (model_routing, tool_trim, payload_cap, loop_cap, session_hygiene, dedupe_reads)
BANDS = ("theoretical", "low", "high")


def plan_changes(corpus: Corpus, policy: Policy) -> DataFrame | None:
    """Changes of every active lever; None under a policy that changes nothing."""
    out, corpus.shared = None, True
    for lever in LEVERS:
        changes = lever(corpus, policy)
        if changes is not None:
            out = changes if out is None else out.unionByName(changes)
    return out


def priced_changes(corpus: Corpus, changes: DataFrame) -> DataFrame:
    """Changes with the request's price and one damped multiplier per reading."""
    net = F.col("token_scale") * F.col("rate_scale")
    priced = changes.withColumn("net", net).join(
        corpus.priced.select(*corpus.by, "request_id", "price"), [*corpus.by, "request_id"]
    )
    usable = (
        (F.col("net") >= 0) & (F.col("net") != 1) & ~F.isnan("net") & (F.col("net") < float("inf"))
    )
    return priced.withColumns(
        {
            band: F.when(usable, damp(F.col("net"), realisation(F.col("tier"), band))).otherwise(
                F.lit(1.0)
            )
            for band in BANDS
        }
    )


def replay(corpus: Corpus, changes: DataFrame) -> DataFrame:
    """Saved credits per request with all levers multiplied together."""
    per_request = priced_changes(corpus, changes).groupBy(*corpus.by, "request_id").agg(
        F.max("price").alias("price"), *[F.product(band).alias(band) for band in BANDS]
    )
    return per_request.select(
        *corpus.by,
        "request_id",
        "price",
        *[F.col(band).alias(f"scale_{band}") for band in BANDS],
        *[(F.col("price") * (1 - F.col(band))).alias(f"saved_{band}") for band in BANDS],
    )


def lever_results(corpus: Corpus, changes: DataFrame) -> DataFrame:
    """Requests affected and credits saved by each lever on its own."""
    rows = priced_changes(corpus, changes).groupBy(*corpus.by, "lever", "tier").agg(
        F.count(F.lit(1)).alias("requests_affected"),
        *[F.sum(F.col("price") * (1 - F.col(b))).alias(f"saved_{b}") for b in BANDS],
    )
    share = F.col("saved_theoretical") / F.col("total_credits")
    totals = corpus.totals.select(*corpus.by, "total_credits")
    return (
        attach(rows, totals, corpus.by)
        .withColumn("share_of_baseline", F.when(F.col("total_credits") > 0, share).otherwise(0.0))
        .drop("total_credits")
        .orderBy(*corpus.by, F.col("saved_theoretical").desc(), "lever")
    )


def simulation_report(corpus: Corpus, policy: Policy) -> DataFrame:
    """Combined saving against the sum and the product of the single levers."""
    by = corpus.by
    changes = plan_changes(corpus, policy)
    baseline = corpus.totals.select(*by, F.col("total_credits").alias("baseline_credits"), "requests")
    if changes is None:
        zero = {f"saved_{b}": F.lit(0.0) for b in BANDS}
        extra = ("naive_sum", "overlap", "multiplicative_estimate")
        return baseline.withColumn("requests_affected", F.lit(0).cast("long")).withColumns(
            {**zero, **{f"reduction_{b}": F.lit(0.0) for b in BANDS}, **{c: F.lit(0.0) for c in extra}}
        )
    # Written once: the combined and the single-lever groupings both read the changes.
    changes = materialise(changes)
    combined = replay(corpus, changes).groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests_affected"),
        *[F.sum(f"saved_{b}").alias(f"saved_{b}") for b in BANDS],
    )
    single = lever_results(corpus, changes).groupBy(*by).agg(
        F.sum("saved_theoretical").alias("naive_sum"),
        (1 - F.product(1 - F.col("share_of_baseline"))).alias("_multiplicative"),
    )
    rows = attach(attach(baseline, combined, by), single, by)
    return rows.select(
        *by,
        "baseline_credits",
        "requests",
        "requests_affected",
        *[f"saved_{b}" for b in BANDS],
        *[
            F.when(F.col("baseline_credits") > 0, F.col(f"saved_{b}") / F.col("baseline_credits"))
            .otherwise(F.lit(0.0))
            .alias(f"reduction_{b}")
            for b in BANDS
        ],
        "naive_sum",
        (F.col("naive_sum") - F.col("saved_theoretical")).alias("overlap"),
        (F.col("_multiplicative") * F.col("baseline_credits")).alias("multiplicative_estimate"),
    )


def contract_ceiling(projections: DataFrame) -> DataFrame:
    """Overage of seats on a plan. Needs `projected_per_seat`, `plan` and `seats`."""
    seats = F.greatest(F.lit(1), F.floor("seats"))
    allowance = F.coalesce(
        *[F.when(F.col("plan") == p, F.lit(float(v[0]))) for p, v in PLAN_ALLOWANCES.items()]
    )
    return (
        projections.withColumn("included_credits", allowance * seats)
        .withColumn("projected_monthly_credits", F.col("projected_per_seat") * seats)
        .withColumn(
            "overage_credits",
            F.greatest(F.lit(0.0), F.col("projected_monthly_credits") - F.col("included_credits")),
        )
        .withColumn(
            "reduction_that_eliminates_overage",
            F.when(
                (F.col("projected_monthly_credits") > 0) & (F.col("overage_credits") > 0),
                F.col("overage_credits") / F.col("projected_monthly_credits"),
            ),
        )
    )


def split_at_ceiling(ceilings: DataFrame, reduction: Column) -> DataFrame:
    """Split a saving into cash and allowance that goes unused."""
    saved = F.col("projected_monthly_credits") * reduction
    cash = F.least(F.greatest(F.lit(0.0), saved), F.col("overage_credits"))
    unused = F.greatest(F.lit(0.0), saved - cash)
    return ceilings.select(
        "*",
        reduction.alias("reduction"),
        saved.alias("saved_credits"),
        cash.alias("cash_credits"),
        unused.alias("unused_allowance_credits"),
        (unused > 0).alias("exceeds_ceiling"),
        F.when(F.col("overage_credits") > 0, cash / F.col("overage_credits"))
        .otherwise(F.lit(0.0))
        .alias("share_of_max_cash_saving"),
    )


def solve_tool_surface(corpus: Corpus, coverage: float = 0.99) -> DataFrame:
    """Tools with their calls and whether they can go while keeping `coverage` of calls."""
    by = corpus.by
    tools = corpus.tool_call.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("calls"))
    total = tools.groupBy(*by).agg(F.sum("calls").alias("total"))
    summed = running(
        tools, by, value_bucket(F.col("calls")), [F.col("calls"), F.col("name")],
        {"upto": ("sum", F.col("calls"))},
    )
    budget = F.floor(F.col("total") * F.lit(1 - coverage))
    return attach(summed, total, by).select(
        *by, "name", "calls", (F.col("upto") <= budget).alias("remove")
    )


def solve_loop_cap(corpus: Corpus) -> DataFrame:
    """Round cap that stops the most unproductive loops, at least half of those it stops.

    Works on a histogram of round counts, which has one row per distinct depth.
    """
    by = corpus.by
    keys = [*by, "request_id"]
    finished = (
        corpus.edit.where(F.col("done") & (F.col("edit_count") > 0)).select(*keys).distinct()
    ).withColumn("productive", F.lit(1))
    histogram = (
        corpus.round_counts.join(finished, keys, "left")
        .groupBy(*by, "rounds")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("productive").isNull(), 1)).alias("idle"),
        )
    )
    tail = running(
        histogram, by, value_bucket(F.col("rounds")), [F.col("rounds")],
        {"caught": ("sum", F.col("n")), "unproductive": ("sum", F.col("idle"))}, reverse=True,
    )
    requests = corpus.request.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))
    good = attach(tail, requests, by).where(
        (F.col("requests") >= MIN_SAMPLE)
        & (F.col("rounds") - 1 >= 10)
        & (F.col("unproductive") / F.col("caught") >= 0.5)
    )
    best = F.struct(-F.col("unproductive"), F.col("rounds"))
    return good.groupBy(*by).agg(
        (F.min_by("rounds", best) - 1).alias("cap"),
        F.min_by("caught", best).alias("caught"),
        F.max("unproductive").alias("unproductive_caught"),
    )


def virtual_tool_threshold(corpus: Corpus) -> DataFrame:
    """Distinct tools per request above which tools are worth grouping; null if immaterial."""
    by = corpus.by
    per_request = (
        corpus.tool_call.select(*by, "request_id", "name")
        .distinct()
        .groupBy(*by, "request_id")
        .agg(F.count(F.lit(1)).alias("tools"))
    )
    picks = rank_pick(per_request, "tools", {"q95": q_ceil(0.95)}, by, count_as="users")
    share = corpus.cost_centre.groupBy(*by).agg(
        (
            F.sum(F.when(F.col("label") == "Tool Definitions", F.col("tokens"))) / F.sum("tokens")
        ).alias("defined_share")
    )
    threshold = F.greatest(F.lit(8), F.col("q95"))
    worth = (F.col("defined_share") >= 0.05) & (F.col("users") >= MIN_SAMPLE)
    return attach(picks, share, by).select(
        *by, F.when(worth, threshold).alias("virtual_tools_threshold")
    )


def output_compression(corpus: Corpus) -> DataFrame:
    """Whether any tool result exceeds 16 000 characters."""
    return corpus.tool_call.groupBy(*corpus.by).agg(
        F.coalesce(F.max("result_chars") > 16_000, F.lit(False)).alias("compress_terminal_output")
    )


def recommend_policy(corpus: Corpus) -> DataFrame:
    """One recommended policy per tenant."""
    by = corpus.by
    surface = solve_tool_surface(corpus).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("remove"), F.col("name")))).alias("deny_tools")
    )
    sizes = rank_pick(corpus.tool_call, "result_chars", {"q95": q_ceil(0.95)}, by, count_as="sized")
    cap = F.when(
        F.col("sized") >= MIN_SAMPLE, F.greatest(F.lit(1000), tokens_from_chars(F.col("q95")))
    )
    parts = (
        solve_loop_cap(corpus).select(*by, F.col("cap").alias("max_rounds")),
        cheapest_measured(corpus.card, by).select(
            *by, F.col("cheapest_model").alias("low_complexity_to")
        ),
        sizes.select(*by, cap.alias("max_result_tokens")),
        virtual_tool_threshold(corpus),
        output_compression(corpus),
    )
    out = surface
    for part in parts:
        out = attach(out, part, by)
    return out.withColumn("nudge_after_turns", F.lit(8)).withColumn("dedupe_reads", F.lit(True))
