"""Ordered analytics that do not put a whole key into one task.

A window partitioned by a key sorts every row of that key in one task. When one key
may hold a third of the data that does not scale, so these helpers split each key
into chunks of its order (a day, a value bucket), run the window per (key, chunk) and
carry totals across chunks. The carry window sees one row per chunk, not per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def value_bucket(value: Column, per_octave: int = 32) -> Column:
    """Bucket number that grows with a numeric value: 32 buckets per factor of two."""
    v = value.cast("double")
    magnitude = F.floor(F.log2(F.abs(v)) * F.lit(per_octave)) + F.lit(per_octave * 1100)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * magnitude)


def running(
    df: DataFrame,
    by: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    measures: dict[str, tuple[str, Column]],
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates per key, computed chunk by chunk.

    `measures` maps an output name to ("sum" | "min" | "max" | "product", expression).
    `order` must be ascending expressions consistent with `chunk`; with `reverse` the
    frame runs from the last row back to the current one, and with `exclusive` it leaves
    the current row out.
    """
    by = list(by)
    rows = df.withColumn("_chunk", chunk)
    for name, (_, expr) in measures.items():
        rows = rows.withColumn(f"_in_{name}", expr)
    totals = rows.groupBy(*by, "_chunk").agg(
        *[_MERGE[kind](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in measures.items()]
    )
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    across = Window.partitionBy(*by).orderBy(chunk_order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = totals.select(
        *by,
        "_chunk",
        *[
            _MERGE[kind](f"_tot_{name}").over(across).alias(f"_carry_{name}")
            for name, (kind, _) in measures.items()
        ],
    )
    within = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(*[o.desc() if reverse else o.asc() for o in order])
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    # Carries grow with the data, whatever a plan guesses; the windows below need this order of both sides anyway.
    out = rows.join(carries.hint("merge"), [*by, "_chunk"])
    for name, (kind, _) in measures.items():
        local, carry = _MERGE[kind](f"_in_{name}").over(within), F.col(f"_carry_{name}")
        if kind == "sum":
            merged = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "product":
            merged = F.coalesce(local, F.lit(1.0)) * F.coalesce(carry, F.lit(1.0))
        else:
            merged = (F.least if kind == "min" else F.greatest)(local, carry)
        out = out.withColumn(name, merged)
    return out.select(*df.columns, *measures)


def row_numbers(
    df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based position of every row of a key, in `order`."""
    return running(df, by, chunk, order, {name: ("sum", F.lit(1).cast("long"))})


def latest_before(
    probes: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    ts: str,
    name: str,
    chunk_ms: int = 86_400_000,
) -> DataFrame:
    """As-of look-up: for each probe the greatest mark time not after it, else null.

    Probes and marks meet per key and chunk, so that probes are shuffled once; only the greatest mark of each
    chunk is carried on to later ones.
    """
    keys = list(keys)
    rows = (
        probes.withColumn("_mark", F.lit(None).cast("long"))
        .unionByName(marks.where(F.col(ts).isNotNull()).select(*keys, ts, F.col(ts).cast("long").alias("_mark")), allowMissingColumns=True)
        .withColumn("_chunk", F.floor(F.col(ts) / chunk_ms))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        rows.groupBy(*keys, "_chunk").agg(F.max("_mark").alias("_last"))
        .select(*keys, "_chunk", F.max("_last").over(before).alias("_carry"))
    )
    # Times of one chunk up to the row's own, those equal to it included.
    within = Window.partitionBy(*keys, "_chunk").orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.lit(True)
    for c in (*keys, ts):
        known = known & F.col(c).isNotNull()
    latest = F.when(known, F.greatest(F.max("_mark").over(within), F.col("_carry")))
    found = rows.join(carries.hint("merge"), [*keys, "_chunk"], "left").withColumn(name, latest)
    return found.where(F.col("_mark").isNull()).select(*probes.columns, name)
