"""Exported git logs: records split by 0x1E, header fields by 0x1F, then numstat lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension_of, hash_identifier, hash_path

RECORD, FIELD = "\x1e", "\x1f"

# Subjects that name a pull request, in order of precedence, and reverts.
PULL_REQUESTS = (
    r"(?i)Merge pull request #(\d+)",
    r"(?i)Merged PR (\d+)",
    r"\(#(\d+)\)\s*$",
    r"(?i)See merge request \S+!(\d+)",
)
REVERT = r"(?i)This reverts commit ([0-9a-f]{7,40})"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records as text; the record separator makes the files splittable."""
    return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "record")


def pull_request(subject: Column) -> Column:
    found = [F.nullif(F.regexp_extract(subject, p, 1), F.lit("")) for p in PULL_REQUESTS]
    return F.coalesce(*found).try_cast("long")


def reverted_sha(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, REVERT, 1), F.lit(""))


def parse_commits(records: DataFrame, salt: str, bodies: DataFrame | None = None) -> DataFrame:
    """One row per commit; `bodies` adds (sha, body) texts that may name a reverted commit."""
    lines = F.split("record", "\n", 2)
    fields = F.split(F.element_at(lines, 1), FIELD)
    at = lambda n: F.try_element_at(fields, F.lit(n))
    rows = records.where(F.trim("record") != "").select(
        at(1).alias("sha"),
        F.coalesce(F.trim(at(2)), F.lit("")).alias("_parents"),
        at(3).alias("_email"),
        at(4).alias("_epoch"),
        F.coalesce(at(5), F.lit("")).alias("_subject"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("_numstat"),
    ).where(F.col("_email").isNotNull() & F.col("_epoch").isNotNull())
    if bodies is None:
        rows = rows.withColumn("_body", F.lit(""))
    else:
        rows = rows.join(bodies.select("sha", F.col("body").alias("_body")), "sha", "left")
    parents = F.when(F.col("_parents") == "", F.array().cast("array<string>")).otherwise(
        F.split("_parents", " ")
    )
    return rows.select(
        "sha",
        hash_identifier(F.lower(F.trim("_email")), salt).alias("author_id"),
        (F.regexp_extract("_epoch", r"^\s*(\d+)", 1).try_cast("long") * 1000).alias("ts"),
        parents.alias("parents"),
        (F.size(parents) > 1).alias("is_merge"),
        pull_request(F.col("_subject")).alias("pull_request"),
        reverted_sha(F.concat_ws("\n", "_subject", "_body")).alias("reverts_sha"),
        "_numstat",
    )


def parse_files(commits: DataFrame, salt: str, root: str = "") -> DataFrame:
    """Changed files of parsed commits; binary files count zero lines."""
    prefix = root.rstrip("/\\") + "/" if root else ""
    parts = F.split("line", "\t")
    number = lambda n: F.coalesce(
        F.regexp_extract(F.element_at(parts, n), r"^\s*(\d+)", 1).try_cast("long"), F.lit(0).cast("long")
    )
    path = F.element_at(parts, 3)
    return (
        commits.select("sha", F.explode(F.split("_numstat", "\n")).alias("line"))
        .where((F.trim("line") != "") & (F.size(parts) >= 3))
        .select(
            "sha",
            hash_path(F.concat(F.lit(prefix), path), salt).alias("path_hash"),
            extension_of(path).alias("extension"),
            number(1).alias("added"),
            number(2).alias("deleted"),
        )
    )
