"""Derived agent profiles and settings compliance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach
from .corpus import Corpus
from .pricing import cheapest_measured

# Tools of a retrieval profile.
RETRIEVAL_TOOLS = ("read_file", "grep_search", "file_search", "semantic_search", "get_errors")
CO_OCCURRENCE, MIN_CLUSTER, MAX_AGENTS = 0.2, 10, 5


def derive_agents(corpus: Corpus) -> DataFrame:
    """Task profiles: requests grouped by their most used tool, with the tools that attend it."""
    by = corpus.by
    keys = [*by, "request_id"]
    per_tool = corpus.tool_call.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))
    lead = per_tool.groupBy(*keys).agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("lead_tool")
    )
    users = lead.groupBy(*by).agg(F.count(F.lit(1)).alias("tool_users"))
    clusters = lead.groupBy(*by, "lead_tool").agg(F.count(F.lit(1)).alias("requests_covered")).where(
        F.col("requests_covered") >= MIN_CLUSTER
    )
    order = Window.partitionBy(*by).orderBy(F.col("requests_covered").desc(), "lead_tool")
    top = clusters.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_AGENTS)
    attending = per_tool.join(lead, keys).groupBy(*by, "lead_tool", "name").agg(
        F.count(F.lit(1)).alias("seen")
    )
    profiles = (
        top.join(attending, [*by, "lead_tool"])
        .where(F.col("seen") / F.col("requests_covered") >= CO_OCCURRENCE)
        .groupBy(*by, "lead_tool", "requests_covered")
        .agg(F.sort_array(F.collect_list("name")).alias("tools"))
    )
    slug = F.lower(F.regexp_replace(F.regexp_replace("lead_tool", r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    tasks = attach(profiles, users, by).select(
        *by,
        F.concat(slug, F.lit("-tasks")).alias("name"),
        "tools",
        F.lit(None).cast("string").alias("model"),
        "requests_covered",
        (F.col("requests_covered") / F.col("tool_users")).alias("coverage"),
    )
    seen = per_tool.where(F.col("name").isin(*RETRIEVAL_TOOLS)).groupBy(*by).agg(
        F.sort_array(F.collect_set("name")).alias("tools")
    )
    retrieval = attach(seen, cheapest_measured(corpus.card, by), by).where(
        (F.size("tools") > 0) & F.col("cheapest_model").isNotNull()
    )
    return tasks.unionByName(
        retrieval.select(
            *by,
            F.lit("retrieval").alias("name"),
            "tools",
            F.col("cheapest_model").alias("model"),
            F.lit(0).cast("long").alias("requests_covered"),
            F.lit(0.0).alias("coverage"),
        )
    )


def verify_settings(intended: DataFrame, effective: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare intended with effective settings of every machine.

    `keys` identify the machine and surface; a machine and surface with no row at all in
    `effective` cannot be verified.
    """
    keys = list(keys)
    visible = effective.select(*keys).distinct().withColumn("_visible", F.lit(True))
    rows = intended.join(effective, [*keys, "setting"], "left").join(visible, keys, "left")
    status = (
        F.when(F.col("_visible").isNull(), "unverifiable")
        .when(F.col("effective").isNull(), "missing")
        .when(F.col("effective") == F.col("intended"), "applied")
        .otherwise("differs")
    )
    return rows.select(*keys, "setting", "intended", "effective", status.alias("status"))


def policy_compliance(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per status; compliant only when every line is applied."""
    kinds = ("applied", "missing", "differs", "unverifiable")
    out = lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.count(F.when(F.col("status") == k, 1)).alias(k) for k in kinds],
    )
    return out.withColumn("ok", (F.col("lines") > 0) & (F.col("applied") == F.col("lines")))
