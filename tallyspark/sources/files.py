"""Smaller inputs and outputs: spans, rosters, cohorts, bundles, questions, workspaces, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonicalise_path, hash_identifier

# Span attributes that carry content and are dropped on sight.
CONTENT_ATTRIBUTES = (
    "gen_ai.prompt", "gen_ai.completion", "gen_ai.content", "gen_ai.request.messages",
    "gen_ai.response.messages", "chat.prompt", "chat.response", "chat.request.content",
    "chat.tool.arguments", "chat.tool.result", "code.filepath", "file.path",
)

OTEL = """resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<name:string,
 startTimeUnixNano:string,attributes:array<struct<key:string,value:struct<stringValue:string,
 intValue:string,doubleValue:double,boolValue:boolean>>>>>>>>>"""

BUNDLE = """bundleVersion int, producedBy string, installId string, team string, periodFrom string,
 periodTo string, developers long, totalCredits double, measuredCredits double, modelledCredits double,
 requestCount long, byModel array<struct<model:string,credits:double,requests:long>>,
 byCostCentre array<struct<label:string,credits:double>>,
 byWasteClass array<struct<class:string,credits:double,confidence:double>>,
 toolSurface array<struct<server:string,toolCount:long,invocations:long>>,
 daily array<struct<day:string,credits:double,requests:long>>,
 manifest array<struct<field:string,why:string>>"""


def read_otel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OTEL).option("multiLine", True).json(path)


def otel_spans(payloads: DataFrame) -> DataFrame:
    """Flattened spans with a map of the attributes that carry no content."""
    spans = (
        payloads.select(F.explode("resourceSpans").alias("r"))
        .select(F.explode("r.scopeSpans").alias("s"))
        .select(F.explode("s.spans").alias("span"))
    )
    attributes = F.coalesce(
        F.col("span.attributes"), F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>")
    )
    content = lambda a: a["key"].isin(*CONTENT_ATTRIBUTES)
    kept = F.filter(attributes, lambda a: ~content(a))
    # A repeated key keeps its last value.
    keys = F.array_distinct(F.transform(kept, lambda a: a["key"]))
    last = lambda key: F.element_at(F.filter(kept, lambda a: a["key"] == key), -1)["value"]
    return spans.select(
        F.col("span.name").alias("name"),
        F.col("span.startTimeUnixNano").alias("nanos"),
        F.map_from_arrays(keys, F.transform(keys, last)).alias("attributes"),
        F.size(F.filter(attributes, content)).cast("long").alias("dropped"),
    )


def otel_turns(spans: DataFrame, salt: str) -> DataFrame:
    """Every span with its turn fields; `usable` is false without model or timestamp."""
    text = lambda key: F.try_element_at("attributes", F.lit(key))["stringValue"]

    def number(key: str) -> Column:
        value = F.try_element_at("attributes", F.lit(key))
        whole = F.regexp_extract(value["intValue"], r"^\s*([+-]?\d+)", 1).try_cast("double")
        return F.coalesce(value["doubleValue"], whole)

    nanos = F.col("nanos").try_cast("decimal(38,0)")
    ts = F.when(nanos > 0, F.floor(nanos / F.lit(1_000_000)).cast("long"))
    model = F.coalesce(text("gen_ai.request.model"), text("chat.model"))
    session = F.coalesce(text("chat.session.id"), text("session.id"), F.lit("unknown"))
    zero = F.lit(0.0)
    return spans.select(
        ts.alias("ts"),
        model.alias("model"),
        F.coalesce(number("gen_ai.usage.input_tokens"), zero).cast("long").alias("prompt_tokens"),
        F.coalesce(number("gen_ai.usage.output_tokens"), zero).cast("long").alias("output_tokens"),
        number("chat.request.credits").alias("credits"),
        hash_identifier(session, salt).alias("session_id"),
        (model.isNotNull() & ts.isNotNull()).alias("usable"),
        "dropped",
    )


def otel_counts(turns: DataFrame) -> DataFrame:
    return turns.agg(
        F.count(F.lit(1)).alias("spans_seen"),
        F.count(F.when(~F.col("usable"), 1)).alias("spans_skipped"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("content_attributes_dropped"),
    )


def _csv_parts(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return lines.where((text != "") & ~text.startswith("#")).select(
        "*", *[F.try_element_at(parts, F.lit(n)).alias(f"_{n}") for n in (1, 2, 3)]
    ).where(F.col("_1") != "")


def parse_roster(lines: DataFrame, salt: str) -> DataFrame:
    """identifier,team,spend lines (`value`, `line_no`); the first row of a unit wins."""
    rows = _csv_parts(lines).where(~F.lower("_1").isin("identifier", "email"))
    spend = F.regexp_extract("_3", r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")
    return (
        rows.select(
            hash_identifier(F.lower("_1"), salt).alias("unit"),
            F.coalesce(F.nullif("_2", F.lit("")), F.lit("unassigned")).alias("team"),
            F.coalesce(spend, F.lit(0.0)).alias("pre_spend"),
            "line_no",
        )
        .groupBy("unit")
        .agg(F.min_by("team", "line_no").alias("team"), F.min_by("pre_spend", "line_no").alias("pre_spend"))
    )


def parse_cohorts(lines: DataFrame, salt: str) -> DataFrame:
    """group,date lines; a missing or unreadable date means never treated."""
    return _csv_parts(lines).select(
        hash_identifier(F.lower("_1"), salt).alias("unit"), F.try_to_date("_2").alias("treated_on")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a number that grows with the file."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of a known version that declare a manifest; malformed files are skipped."""
    rows = (
        spark.read.schema(BUNDLE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    return valid_bundles(rows)


def valid_bundles(rows: DataFrame) -> DataFrame:
    kept = rows.where((F.col("bundleVersion") == 1) & F.col("manifest").isNotNull())
    return kept.select(
        F.col("installId").alias("install_id"),
        "team",
        F.col("periodFrom").alias("period_from"),
        F.col("periodTo").alias("period_to"),
        "developers",
        F.col("totalCredits").alias("total_credits"),
        F.col("measuredCredits").alias("measured_credits"),
        F.col("modelledCredits").alias("modelled_credits"),
        F.col("requestCount").alias("request_count"),
        F.col("byModel").alias("by_model"),
        F.col("byCostCentre").alias("by_cost_centre"),
        F.col("byWasteClass").alias("by_waste_class"),
        F.transform(
            "toolSurface",
            lambda s: F.struct(s["server"].alias("server"), s["toolCount"].alias("tool_count"), s["invocations"].alias("invocations")),
        ).alias("tool_surface"),
        "daily",
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    schema = "questionHash string, askedBy string, credits double, ts long"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(
        F.col("questionHash").alias("question_hash"), F.col("askedBy").alias("asked_by"), "credits", "ts"
    )


def decode_folder_uri(uri: Column) -> Column:
    """Display path of a folder URI; case is kept, one trailing slash is dropped."""
    bare = F.regexp_replace(F.trim(uri), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    path = F.regexp_replace(F.regexp_replace(decoded, r"\\", "/"), r"/{2,}", "/")
    path = F.regexp_replace(path, r"^/([A-Za-z]:)", "$1")
    return F.regexp_replace(path, r"(?<=.)/$", "")


def read_workspace_map(
    workspaces: DataFrame, documents: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Location of every workspace, or why it has none.

    `documents` holds (workspace_id, text) of the workspace files. With `existing`, a list
    of folders known to exist, other folders are marked as gone.
    """
    rows = workspaces.select("workspace_id").distinct().join(documents, "workspace_id", "left")
    parsed = F.try_parse_json("text")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(parsed, p, "variant"))
    folder = F.try_variant_get(parsed, "$.folder", "string")
    reason = (
        F.when(F.col("text").isNull(), "no-workspace-json")
        .when(parsed.isNull(), "malformed-workspace-json")
        .when(kind("$.workspace") == "STRING", "multi-root-workspace")
        .when(F.coalesce((kind("$.folder") != "STRING") | (F.trim(folder) == ""), F.lit(True)), "empty-window")
    )
    placed = reason.isNull()
    out = rows.select(
        "workspace_id",
        F.when(placed, canonicalise_path(folder)).alias("canonical_path"),
        F.when(placed, decode_folder_uri(folder)).alias("display_path"),
        reason.alias("unattributed_reason"),
    ).withColumn("label", F.element_at(F.filter(F.split("display_path", "/"), lambda p: p != ""), -1))
    if existing is not None:
        known = existing.select("display_path").distinct().withColumn("_here", F.lit(True))
        out = out.join(known, "display_path", "left").withColumn(
            "unattributed_reason",
            F.coalesce(
                "unattributed_reason",
                F.when(F.col("_here").isNull(), "folder-no-longer-present"),
            ),
        ).drop("_here")
    return out.select("workspace_id", "canonical_path", "display_path", "label", "unattributed_reason")


def write_export(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table of a report as JSON under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def write_contribution(contributions: DataFrame, path: str) -> None:
    """Replace only the months that are written."""
    (
        contributions.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period")
        .parquet(path)
    )
