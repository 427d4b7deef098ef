"""Query registration: a name, a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_tables import with_tables
from .tables import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register a function of a Testbed; `sql` may name any telemetry table."""

    def register(build: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql, **ctes)
        return build

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double, so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
