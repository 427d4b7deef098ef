"""Checks and suppressions before anything is shared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_path_redacted, short_id
from .duplication import MIN_GROUP_SIZE

# Fields that name one person or machine, and fields that hold paths.
FORBIDDEN = {"sessionId", "rawPath", "absolutePath", "userName", "homeDir"}
PATHS = {"sourceFile", "file", "filePath", "path"}


class PrivacyError(ValueError):
    """A report would expose an individual."""


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def k_anonymise(groups: DataFrame, label: str, subjects: Column, k: int = MIN_GROUP_SIZE) -> DataFrame:
    """Withhold the label of groups under k subjects; their figures stay."""
    small = subjects < k
    return groups.withColumn("suppressed", small).withColumn(
        label, F.when(small, F.lit(f"withheld (<{k} developers)")).otherwise(F.col(label))
    )


def sharing_allowed(subjects: int, scope: str = "shared") -> bool:
    """One person's own report, or a group of at least five."""
    return scope == "self" or subjects <= 1 or subjects >= MIN_GROUP_SIZE


def _walk(kind: T.DataType, value: Column, at: str, out: list[tuple[str, Column]]) -> None:
    """Collect (position, violating-value count) for every field of a schema."""
    if isinstance(kind, T.ArrayType):
        parts: list[tuple[str, Column]] = []
        probe = F.col("_probe")
        _walk(kind.elementType, probe, at + "[]", parts)

        def counter(index: int):
            def count(item: Column) -> Column:
                found: list[tuple[str, Column]] = []
                _walk(kind.elementType, item, at + "[]", found)
                return found[index][1]

            return count

        for index, (place, _) in enumerate(parts):
            total = F.aggregate(
                F.transform(value, counter(index)), F.lit(0).cast("long"), lambda a, b: a + b
            )
            out.append((place, F.coalesce(total, F.lit(0).cast("long"))))
    elif isinstance(kind, T.StructType):
        for field in kind.fields:
            name, inner = _camel(field.name), value[field.name]
            place = f"{at}.{field.name}"
            if name in FORBIDDEN:
                out.append((place, inner.isNotNull().cast("long")))
            elif name in PATHS and isinstance(field.dataType, T.StringType):
                bad = inner.isNotNull() & ~is_path_redacted(inner)
                out.append((place, F.coalesce(bad, F.lit(False)).cast("long")))
            else:
                _walk(field.dataType, inner, place, out)


def audit_shareable(report: DataFrame) -> DataFrame:
    """Fields of a report that would expose someone, with how many values do."""
    checks: list[tuple[str, Column]] = []
    _walk(report.schema, F.struct(*report.columns), "$", checks)
    if not checks:
        return report.sparkSession.range(0).select(
            F.lit("").alias("field"), F.lit(0).cast("long").alias("violations")
        )
    counts = report.agg(
        F.array(
            *[
                F.struct(F.lit(at).alias("field"), F.coalesce(F.sum(bad), F.lit(0)).alias("violations"))
                for at, bad in checks
            ]
        ).alias("c")
    )
    return counts.select(F.explode("c").alias("c")).select("c.*").where(F.col("violations") > 0)


def assert_shareable(report: DataFrame, subjects: int, scope: str = "shared") -> DataFrame:
    """Return the report, or raise when it may not be shared."""
    if scope == "self":
        return report
    if not sharing_allowed(subjects, scope):
        raise PrivacyError(f"a shared report over {subjects} developers can be taken apart")
    # One row per offending field of the schema.
    found = audit_shareable(report).collect()
    if found:
        raise PrivacyError("; ".join(f"{row.field}: {row.violations}" for row in found))
    return report


def redact_evidence(findings: DataFrame, subjects: int, scope: str = "shared") -> DataFrame:
    """Drop per-request and per-session evidence, noting how much was withheld."""
    if scope == "self" or subjects >= MIN_GROUP_SIZE:
        shortened = F.transform(
            "evidence",
            lambda e: F.when(e["kind"] == "session", e.withField("ref", short_id(e["ref"]))).otherwise(e),
        )
        return findings.withColumn("evidence", shortened)
    personal = lambda e: e["kind"].isin("request", "session")
    kept = F.filter("evidence", lambda e: ~personal(e))
    removed = F.size(F.filter("evidence", personal)).cast("long")
    note = F.struct(
        F.lit("tool").alias("kind"),
        F.lit("WITHHELD").alias("ref"),
        removed.alias("count"),
        F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("double").alias("credits"),
    )
    return findings.withColumn(
        "evidence", F.when(removed > 0, F.concat(kept, F.array(note))).otherwise(kept)
    )


def audit_manifest(report: DataFrame, declared: Sequence[str], structural: Sequence[str] = ()) -> list[str]:
    """Columns that leave without being declared."""
    allowed = {*declared, *structural}
    return [c for c in report.columns if c not in allowed]
