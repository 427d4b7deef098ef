"""Tool servers and how much they are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ACTIVE_CALLS_PER_REQUEST, MARGINAL_CALLS_PER_REQUEST, server_of
from ..session import attach


def tool_surface(tool_call: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct tools and invocations per server."""
    per_tool = tool_call.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("calls"))
    return (
        per_tool.withColumn("server", server_of(F.col("name")))
        .groupBy(*by, "server")
        .agg(F.count(F.lit(1)).alias("tool_count"), F.sum("calls").alias("invocations"))
    )


def tool_server_roi(
    tool_call: DataFrame, request: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    by = list(by)
    surface = tool_surface(tool_call, by)
    # Both denominators come from small aggregates, never from a second pass over calls.
    calls = surface.groupBy(*by).agg(F.sum("invocations").alias("_calls"))
    requests = request.groupBy(*by).agg(F.count(F.lit(1)).alias("_requests"))
    rows = attach(attach(surface, calls, by), requests, by)
    rate = F.col("invocations") / F.greatest(F.lit(1), F.coalesce("_requests", F.lit(0)))
    return rows.select(
        *by,
        "server",
        "tool_count",
        "invocations",
        (F.col("invocations") / F.col("_calls")).alias("invocation_share"),
        F.when(rate >= ACTIVE_CALLS_PER_REQUEST, "active")
        .when(rate >= MARGINAL_CALLS_PER_REQUEST, "marginal")
        .otherwise("unused-in-window")
        .alias("verdict"),
    ).orderBy(*by, F.col("invocations").desc(), "server")
