"""Scalar expressions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USD_PER_CREDIT = 0.01
TOKENS_PER_RATE_UNIT = 1000
CHARS_PER_TOKEN = 4

# Realised share of a theoretical saving, by tier (low, high).
REALISATION = {"A": (0.7, 1.0), "B": (0.5, 0.9), "C": (0.1, 0.5)}

# Waste-report verdict floors, in calls per request.
ACTIVE_CALLS_PER_REQUEST = 0.25
MARGINAL_CALLS_PER_REQUEST = 0.05


def round_half_up(x: Column) -> Column:
    """Nearest integer with halves going up."""
    return F.floor(x + F.lit(0.5))


def canonicalise_path(path: Column) -> Column:
    """One spelling per file: no scheme, decoded, forward slashes, lower case."""
    bare = F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    # try_url_decode reads '+' as a space, so plus signs are escaped first.
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    slashes = F.regexp_replace(F.regexp_replace(decoded, r"\\", "/"), r"/{2,}", "/")
    return F.lower(F.regexp_replace(slashes, r"^/([A-Za-z]:)", "$1"))


def hash_identifier(value: Column, salt: str | Column) -> Column:
    """First 16 hex digits of sha256(salt || value)."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    return F.substring(F.sha2(F.concat(salt, value), 256), 1, 16)


def hash_path(path: Column, salt: str | Column) -> Column:
    return hash_identifier(canonicalise_path(path), salt)


def to_relative_path(path: Column) -> Column:
    """Part after the first workspace storage folder; unchanged outside of one."""
    slashes = F.regexp_replace(path, r"\\", "/")
    return F.when(
        slashes.contains("/workspaceStorage/"),
        F.regexp_extract(slashes, r"^.*?/workspaceStorage/(.*)$", 1),
    ).otherwise(path)


def is_path_redacted(path: Column) -> Column:
    """True when the value shows no drive, root, home or workspace storage folder."""
    return ~path.rlike(r"^[A-Za-z]:[\\/]|^[\\/]|[\\/](Users|home)[\\/]|workspaceStorage")


def short_id(identifier: Column) -> Column:
    return F.substring(identifier, 1, 8)


def tokens_from_chars(chars: Column) -> Column:
    return round_half_up(chars / F.lit(CHARS_PER_TOKEN))


def canonicalise_model_id(model: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(model), r"[._]", "-"), r"-{2,}", "-")


def server_of(tool: Column) -> Column:
    """Tool server behind a tool name."""
    return (
        F.when(
            tool.startswith("mcp_"),
            F.concat(F.lit("mcp:"), F.substring_index(F.substring(tool, 5, 1_000_000), "_", 1)),
        )
        .when(tool.contains("/"), F.substring_index(tool, "/", 1))
        .otherwise(F.lit("built-in"))
    )


def ts_of(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def day_key(ts_ms: Column) -> Column:
    """UTC day of an epoch-millisecond column."""
    return F.to_date(F.timestamp_millis(ts_ms))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_bounds(month: Column) -> tuple[Column, Column]:
    first = F.to_date(F.concat(month, F.lit("-01")))
    return first, F.last_day(first)


def week_start(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", day))


def preceding_window(start: Column, end: Column) -> tuple[Column, Column]:
    """The equally long window that ends the day before `start`."""
    length = F.datediff(end, start) + F.lit(1)
    return F.date_sub(start, length), F.date_sub(start, F.lit(1))


def in_date_range(day: Column, start: str | None = None, end: str | None = None) -> Column:
    keep = F.lit(True)
    if start is not None:
        keep = keep & (day >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (day <= F.lit(end).cast("date"))
    return keep


def workspace_id_of(source_file: Column) -> Column:
    """First path segment; null when there is none or it is a drive letter."""
    slashes = F.regexp_replace(source_file, r"\\", "/")
    first = F.regexp_extract(slashes, r"^([^/]+)/", 1)
    return F.when((first != "") & ~first.rlike(r"^[A-Za-z]:$"), first)


def is_at_or_beneath(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def credits_to_usd(credits: Column) -> Column:
    return credits * F.lit(USD_PER_CREDIT)


def clamp01(x: Column) -> Column:
    """Clamp to [0, 1]; anything not finite counts as 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(F.lit(0.0))


def sample_confidence(n: Column, half: float = 20) -> Column:
    return F.when(n > 0, n / (n + F.lit(half))).otherwise(F.lit(0.0))


def with_effect_size(confidence: Column, effect: Column) -> Column:
    return clamp01(confidence * clamp01(effect))


def provenance_kind(measured: Column, modelled: Column) -> Column:
    """Which kinds of money a sum is made of."""
    return (
        F.when(modelled == 0, "measured").when(measured == 0, "modelled").otherwise("blended")
    )


def measured_percent(measured: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100)).otherwise(
        round_half_up(F.lit(100.0) * measured / total)
    ).cast("long")


def extension_of(path: Column) -> Column:
    """Lower-case file extension, empty for dotfiles and names without one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def match_tool_pattern(name: Column, pattern: str) -> Column:
    """Exact name, or prefix when the pattern ends in '*'."""
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == F.lit(pattern)


def length_bucket(turns: Column) -> Column:
    return (
        F.when(turns <= 5, "1-5")
        .when(turns <= 20, "6-20")
        .when(turns <= 50, "21-50")
        .when(turns <= 100, "51-100")
        .otherwise("100+")
    )


def band_of(score: Column, low_ceiling: Column, medium_ceiling: Column) -> Column:
    return (
        F.when(score <= low_ceiling, "low").when(score <= medium_ceiling, "medium").otherwise("high")
    )


def realisation(tier: Column, band: str) -> Column:
    """Realised share for the 'low', 'high' or 'theoretical' reading of a tier."""
    if band == "theoretical":
        return F.lit(1.0)
    pick = {"low": 0, "high": 1}[band]
    shares = [F.when(tier == name, F.lit(values[pick])) for name, values in REALISATION.items()]
    return F.coalesce(*shares, F.lit(0.0))


def damp(scale: Column, share: Column) -> Column:
    """Move a cost multiplier towards 1 by the share that will not be realised."""
    return F.lit(1.0) - (F.lit(1.0) - scale) * share
