"""Normalised tables on disk: idempotent upsert, scans and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def latest_versions(requests: DataFrame, version: str = "version") -> DataFrame:
    """The newest version of every request."""
    newest = F.struct(version, "source_file", "source_offset")
    rows = requests.groupBy("request_id").agg(F.max_by(F.struct(*requests.columns), newest).alias("r"))
    return rows.select("r.*")


def surviving_children(children: DataFrame, latest: DataFrame, version: str = "version") -> DataFrame:
    """Child rows of the surviving version only: children are replaced, never merged."""
    return children.join(latest.select("request_id", version), ["request_id", version], "left_semi")


def sessions(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(
        F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at")
    )


def version_of(batch: int):
    """Version column of an ingest batch."""
    return F.lit(batch).cast("long")
