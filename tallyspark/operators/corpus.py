"""The telemetry tables of one analysis, with the shared derived tables built once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import TOP, bounded
from ..session import materialise, written
from .pricing import derive_rate_card, price_requests, spend


# Tools whose result is the content of a file.
READ_TOOLS = ("read_file", "get_errors")
# Cost centres that detectors and levers look at one by one.
CENTRES = ("Tool Definitions", "Tool Results", "Files", "System Instructions")


@dataclass
class Corpus:
    request: DataFrame
    cost_centre: DataFrame
    tool_call: DataFrame
    round: DataFrame
    edit: DataFrame
    compaction: DataFrame
    content_reference: DataFrame
    by: list[str] = field(default_factory=list)
    commit_file: DataFrame | None = None
    question: DataFrame | None = None
    #: Set by reports that read what requests add up to many times: it is then written once, see `sums` and `facts`.
    shared: bool = False

    @cached_property
    def card(self) -> DataFrame:
        """Rate card of the whole corpus, computed once; it has one row per model."""
        return materialise(derive_rate_card(self.request, self.by))

    @cached_property
    def priced(self) -> DataFrame:
        return price_requests(self.request, self.card, self.by)

    @cached_property
    def totals(self) -> DataFrame:
        """Credits, prompt tokens, requests and blended credits per token, one row per tenant."""
        whole = spend(self.request, self.card, {}, self.by)
        return whole.select(
            *self.by,
            F.col("credits").alias("total_credits"),
            F.col("prompt_tokens").alias("total_tokens"),
            F.col("request_count").alias("requests"),
            F.when(F.col("prompt_tokens") > 0, F.col("credits") / F.col("prompt_tokens"))
            .otherwise(F.lit(0.0))
            .alias("credits_per_token"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Tool calls with the session and time of their request."""
        return tool_calls_of_requests(self.tool_call, self.request, self.by)

    @cached_property
    def read_calls(self) -> DataFrame:
        """Read calls with a known file, their line range and their place in the session.

        Written once, because the re-read scan groups, semi-joins and as-of-joins it.
        """
        reads = self.calls.where(
            F.col("name").isin(*READ_TOOLS) & F.col("target_file_hash").isNotNull()
        )
        return materialise(
            reads.select(
                *self.by,
                "request_id",
                "session_id",
                F.col("target_file_hash").alias("file_hash"),
                "ts",
                F.coalesce("result_chars", F.lit(0)).alias("chars"),
                bounded(F.coalesce("target_start_line", F.lit(0))).alias("start"),
                bounded(F.coalesce("target_end_line", F.lit(TOP))).alias("end"),
                F.struct("ts", "request_id", "round_id", "tool_call_id").alias("place"),
                (F.col("target_start_line").isNull() & F.col("target_end_line").isNull()).alias(
                    "whole_file"
                ),
            )
        )

    @cached_property
    def rereads(self) -> DataFrame:
        """Re-reads, written once: detectors and levers group them in several ways."""
        from .waste.rereads import scan_rereads

        return materialise(scan_rereads(self))

    @cached_property
    def sums(self) -> DataFrame:
        """Rounds, complexity points and cost centres of each request id that a child table names, in one shuffle.

        `points` counts 1/500 points, so that sums are exact integers; `has_i` tells rows of a centre, whose tokens may be null.
        """
        keys = [*self.by, "request_id"]
        kind = self.cost_centre.schema["tokens"].dataType
        children = (
            self.round.select(
                *keys, F.lit(1).alias("rounds"), (F.lit(1000) + F.coalesce("thinking_tokens", F.lit(0))).cast("long").alias("points")
            ),
            self.tool_call.select(*keys, F.lit(500).cast("long").alias("points")),
            self.edit.select(*keys, (F.col("edit_count") * 1500).alias("points")),
            self.cost_centre.select(*keys, "label", "tokens"),
        )
        empty = {"rounds": "int", "points": "long", "label": "string", "tokens": kind}
        rows = None
        for child in children:
            row = child.select(*keys, *[c if c in child.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])
            rows = row if rows is None else rows.unionByName(row)
        own = [F.col("label") == c for c in CENTRES]
        return written(
            rows.groupBy(*keys).agg(
                F.sum("rounds").alias("rounds"),
                F.sum("points").alias("points"),
                *[F.sum(F.when(o, F.col("tokens"))).alias(f"tokens_{i}") for i, o in enumerate(own)],
                *[(F.count(F.when(o, 1)) > 0).alias(f"has_{i}") for i, o in enumerate(own)],
            )
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Every request with its `sums`, written once."""
        request = self.request.select(*self.by, "request_id", "session_id", "ts", "model", "prompt_tokens", "output_tokens")
        return written(request.join(self.sums, [*self.by, "request_id"], "left"))

    def centre_tokens(self, label: str) -> DataFrame:
        """Tokens of one cost-centre label per request."""
        keys = [*self.by, "request_id"]
        if self.shared:
            i = CENTRES.index(label)
            return self.sums.where(f"has_{i}").select(*keys, F.col(f"tokens_{i}").alias("tokens"))
        return self.cost_centre.where(F.col("label") == label).groupBy(*keys).agg(F.sum("tokens").alias("tokens"))

    def requests_with(self, label: str) -> DataFrame:
        """Requests that have the cost centre: keys, session, time, prompt and the centre's tokens."""
        columns = [*self.by, "request_id", "session_id", "ts", "prompt_tokens"]
        if self.shared:
            i = CENTRES.index(label)
            return self.facts.where(f"has_{i}").select(*columns, F.col(f"tokens_{i}").alias("tokens"))
        return self.request.select(*columns).join(self.centre_tokens(label), [*self.by, "request_id"])

    @cached_property
    def round_counts(self) -> DataFrame:
        """Rounds per request, for requests that have any."""
        if self.shared:
            return self.sums.where(F.col("rounds").isNotNull()).select(*self.by, "request_id", "rounds")
        return self.round.groupBy(*self.by, "request_id").agg(F.count(F.lit(1)).alias("rounds"))


def tool_calls_of_requests(
    tool_call: DataFrame, request: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    keys = [*by, "request_id"]
    return tool_call.join(request.select(*keys, "session_id", "ts"), keys)
