"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _pointed(edges: DataFrame, both: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of the node and its neighbours.

    `both`: each node sees all neighbours and moves the larger ones (large star); otherwise it sees the
    smaller ones and moves them and itself (small star). Grouped minima and equality joins only, so a node
    with very many neighbours is pre-aggregated and its rows can be split.
    """
    seen = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = seen.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = seen.join(least, "u")
    if both:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the smallest node.

    Self-links and repeated edges do no harm; an empty table gives an empty one.
    """
    current = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = None
    while True:
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            break
        mark = (row["n"], row["h"])
        current = written(_pointed(_pointed(current, True), False))
    # At rest each node has one edge, to the smallest node of its component.
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
