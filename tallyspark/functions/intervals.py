"""Overlap tests between integer intervals without comparing pairs.

An interval is a union of few dyadic blocks (its cover). Two intervals overlap exactly
when a block of one cover equals, or lies inside, a block of the other. So each
interval is listed under its cover blocks and under the blocks that enclose them; the
smallest label among all overlapping intervals is then a plain grouped minimum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The last line; two more still fit a long.
TOP = 2**63 - 3


def bounded(line: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(TOP), line)).cast("long")


def clipped(end: Column, reach: Column) -> Column:
    """End of a range cut just past `reach`, the last finite line of its key.

    All ranges of the key start at or before `reach`, so no overlap appears or vanishes,
    and the blocks of the key need fewer levels.
    """
    return F.least(end, reach + 1)


def levels_for(reach: Column) -> Column:
    """Block levels that span lines 0 to reach + 1."""
    return F.length(F.bin(reach + 1))


def _blocks(start: Column, end: Column, levels: Column) -> Column:
    """Array of (level, block, covers): cover blocks and their enclosing blocks."""

    def at_level(level: Column) -> Column:
        halved = lambda line: F.call_function("shiftright", line, level)
        low, high = halved(start - 1) + 1, halved(end + 1)
        first, last = halved(start), halved(end)

        def block(at: Column, covers: bool) -> Column:
            return F.struct(
                level.alias("level"), at.cast("long").alias("block"), F.lit(covers).alias("covers")
            )

        return F.array_compact(
            F.array(
                F.when((low < high) & (low % 2 == 1), block(low, True)),
                F.when((low < high) & (high % 2 == 1) & (high - 1 >= low), block(high - 1, True)),
                F.when((first < low) | (first >= high), block(first, False)),
                F.when(
                    ((last < low) | (last >= high)) & (last != first), block(last, False)
                ),
            )
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), levels), at_level))


def first_overlapping(
    ranges: DataFrame,
    keys: Sequence[str],
    inner: str,
    start: str,
    end: str,
    label: str,
    inner_name: str,
    name: str,
    levels: str,
) -> DataFrame:
    """Smallest `label` among the ranges of the same key that overlap each range.

    `name` looks at all ranges of `keys`, `inner_name` only at those that also share
    `inner`. Every range overlaps itself, so a range with no earlier neighbour gets its
    own label. `ranges` should be distinct per (keys, inner, start, end); `levels` is a
    column with the block levels of the key.
    """
    node = [*keys, "_level", "_block"]
    columns = [*keys, inner, start, end, label]
    listed = ranges.select(*columns, F.explode(_blocks(F.col(start), F.col(end), F.col(levels))).alias("_at")).select(
        *columns,
        F.col("_at.level").alias("_level"),
        F.col("_at.block").alias("_block"),
        F.col("_at.covers").alias("_covers"),
    )
    # Both minima are told where a block's distinct ranges meet, so that the listing is shuffled once.
    inside, overall = Window.partitionBy(*node, inner), Window.partitionBy(*node)

    def pick(over):
        """A cover block meets every range listed under it; an enclosing block meets covers only."""
        cover = F.min(F.when(F.col("_covers"), F.col(label))).over(over)
        return F.when(F.col("_covers"), F.min(label).over(over)).otherwise(cover)

    met = listed.repartition(*node).select(*keys, inner, start, end, pick(inside).alias("_inside"), pick(overall).alias("_overall"))
    return met.groupBy(*keys, inner, start, end).agg(F.min("_inside").alias(inner_name), F.min("_overall").alias(name))
