"""Session settings and the few places where a job touches shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension of at most this many rows may be broadcast. Rows of the dimensions
# used here (rate card, plan table, metric definitions) are well under 1 kB.
BROADCAST_ROW_LIMIT = 100_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; days are UTC days."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; only a local session may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it from there on."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder as Parquet: later reads take only the columns that they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str = "left",
    row_limit: int = BROADCAST_ROW_LIMIT,
) -> DataFrame:
    """Join a materialised dimension, broadcasting it only when its counted size allows.

    Past the limit the join is left to Spark, which shuffles both sides and splits
    skewed partitions at run time.
    """
    small = dimension.limit(row_limit + 1).count() <= row_limit
    return facts.join(F.broadcast(dimension) if small else dimension, on, how)


def attach(df: DataFrame, stats: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Add the columns of `stats` (one row per tenant, or one row in all) to `df`."""
    columns = [c for c in stats.columns if c not in by]
    if by:
        return df.join(stats, list(by), "left")
    row = stats.select(F.struct(*columns).alias("row")).scalar()
    return df.withColumns({c: row[c] for c in columns})
