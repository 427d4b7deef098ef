"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

A row's place follows from its number, the row count and the seed alone, in both directions, so no
sort by a random key is needed and any worker can find which row fills a given slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, written

ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 64))


def _network(x: np.ndarray, half: int, keys: np.ndarray, inverse: bool) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for key in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ key) & mask)
    return (left << bits) | right


def permute(x: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """A bijection of 0..n-1. The network permutes the next power of four; values past n walk on."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    keys = _keys(seed)
    out = _network(np.asarray(x).astype(np.uint64), half, keys, inverse)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, keys, inverse)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row that fills a slot: the inverse of the placement."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def row_numbers(df: DataFrame, order: list[str], name: str = "row", size: str | None = None) -> DataFrame:
    """Number the rows from 0 in the given order, without a single-task sort of the rows.

    Range partitions are sorted and written once, each row with its partition and place; only the
    partitions' totals are added up in one task. With `size`, the number is the sum of `size` before the row.
    """
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    if size:
        inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(size).over(inside), F.lit(0))
    totals = placed.groupBy("__part").agg((F.sum(size) if size else F.count("*")).alias("__n"))
    starts = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__within", within).join(starts, "__part")
    return numbered.withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__before", "__within", "__at")


def assign_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add `row`, `shard` and `slot` to every row of `df`, which should be narrow (keys, not texts).

    Shards' row counts differ by one at most and slots have no gaps. Rows that are equal in all of
    `order` are numbered in any order among themselves. Null keys come first; an empty table stays empty.
    """
    rows = row_numbers(df, order)
    n = df.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    at = rows.withColumn("__place", place("row"))
    return at.select(
        *rows.columns, (F.col("__place") % shards).cast("int").alias("shard"), F.expr(f"__place div {shards}").alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20_240_229) -> DataFrame:
    """Place documents by `doc_id`, ties by text: doc_id, size, text_crc32, row, shard, slot.

    A null text has size 8 and the checksum of an empty text. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign_shards(narrow, ["doc_id", "text_crc32", "size"], shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 20_240_229) -> None:
    """Write whole documents as one folder per shard, each file in slot order.

    Documents that repeat an id and text are interchangeable; their copies take the places in turn.
    """
    key = ["doc_id", "text_crc32", "size"]
    text = F.coalesce(F.col("text"), F.lit(""))
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    placed = shard_documents(docs, shards, seed).withColumn("__copy", copy).drop("row")
    full = docs.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)}).withColumn("__copy", copy)
    (
        full.alias("f")
        .join(placed.alias("p"), F.expr(" AND ".join(f"f.{c} <=> p.{c}" for c in [*key, "__copy"])))
        .select("f.doc_id", "f.text", "p.slot", "p.shard")
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
