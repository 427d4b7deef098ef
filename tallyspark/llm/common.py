"""Shared pieces of the operators: tables, the shared folder, words and bounded memories."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Bytes handed to a Python worker at once; a batch of long documents stays small.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it from there: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learns(doc_id: str, folds: int) -> Column:
    """True for rows outside the held-out fold, which holds ids whose crc32 modulo `folds` is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds != 1, F.lit(True))


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than the six ASCII white-space characters."""
    return (data or b"").lower().split()


class Memo(dict):
    """A dictionary that computes missing values and starts afresh at `limit` entries."""

    def __init__(self, compute, limit: int = 300_000) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers by shifts and odd multiplications."""
    x = x.astype(np.uint64, copy=True)
    for multiplier in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x ^= x >> np.uint64(32)
        x *= np.uint64(multiplier)
    return x ^ (x >> np.uint64(29))
