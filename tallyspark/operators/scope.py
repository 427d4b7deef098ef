"""Workspace scopes and the project tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonicalise_path


def workspaces_with_spend(locations: DataFrame, stats: DataFrame) -> DataFrame:
    """Every known workspace with its spend, zero when it never sent a request."""
    return locations.join(stats, "workspace_id", "left").withColumns(
        {
            "credits": F.coalesce("credits", F.lit(0.0)),
            "measured_credits": F.coalesce("measured_credits", F.lit(0.0)),
            "request_count": F.coalesce("request_count", F.lit(0).cast("long")),
        }
    )


def ancestors(path: Column) -> Column:
    """The path and every folder above it, by splitting at slashes."""
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    return F.filter(prefixes, lambda p: p != "")


def resolve_scope(locations: DataFrame, anchors: Sequence[str] | DataFrame, mode: str = "folder") -> DataFrame:
    """Workspaces selected by a mode: all of them, those at an anchor, or at or beneath one.

    The prefix test becomes an equality join: a workspace lies beneath an anchor exactly
    when the anchor is one of its ancestor paths.
    """
    if mode == "all":
        return locations
    if isinstance(anchors, DataFrame):
        wanted = anchors.select(canonicalise_path(F.col("anchor")).alias("_anchor"))
    else:
        spark = locations.sparkSession
        wanted = spark.createDataFrame([(a,) for a in anchors], "anchor string").select(
            F.regexp_replace(canonicalise_path(F.col("anchor")), "(?<=.)/$", "").alias("_anchor")
        )
    placed = locations.where(F.col("canonical_path").isNotNull())
    if mode == "workspace":
        return placed.join(
            wanted.withColumnRenamed("_anchor", "canonical_path"), "canonical_path", "left_semi"
        ).select(locations.columns)
    exploded = placed.select("workspace_id", F.explode(ancestors(F.col("canonical_path"))).alias("_anchor"))
    inside = exploded.join(wanted, "_anchor", "left_semi").select("workspace_id").distinct()
    return locations.join(inside, "workspace_id", "left_semi")


def project_tree(workspaces: DataFrame) -> DataFrame:
    """Own and subtree spend per folder, and the nearest folder above that also has spend.

    `workspaces` has workspace_id, canonical_path, unattributed_reason, credits and
    request_count. Folders come from workspaces only; unattributed spend keeps one row
    per reason, so the total stays complete.
    """
    placed = workspaces.where(
        F.col("unattributed_reason").isNull() & F.col("canonical_path").isNotNull()
    )
    own = placed.groupBy(F.col("canonical_path").alias("folder")).agg(
        F.count(F.lit(1)).alias("workspaces"),
        F.sum("credits").alias("own_credits"),
        F.sum("request_count").alias("own_requests"),
    )
    names = own.select(F.col("folder").alias("above"))
    upward = own.withColumn("above", F.explode(ancestors(F.col("folder")))).join(names, "above")
    subtree = upward.groupBy("above").agg(
        F.sum("own_credits").alias("subtree_credits"), F.sum("own_requests").alias("subtree_requests")
    )
    parents = (
        upward.where(F.col("above") != F.col("folder"))
        .groupBy("folder")
        .agg(F.max_by("above", F.length("above")).alias("parent"))
    )
    folders = (
        own.join(subtree.withColumnRenamed("above", "folder"), "folder")
        .join(parents, "folder", "left")
        .withColumn("unattributed_reason", F.lit(None).cast("string"))
    )
    lost = workspaces.where(F.col("unattributed_reason").isNotNull()).groupBy("unattributed_reason").agg(
        F.count(F.lit(1)).alias("workspaces"),
        F.sum("credits").alias("own_credits"),
        F.sum("request_count").alias("own_requests"),
    )
    lost = lost.withColumns(
        {
            "folder": F.lit(None).cast("string"),
            "parent": F.lit(None).cast("string"),
            "subtree_credits": F.col("own_credits"),
            "subtree_requests": F.col("own_requests"),
        }
    )
    return folders.unionByName(lost).orderBy(F.col("subtree_credits").desc(), "folder")
