"""Telemetry tables as projections of the TPC-H-like test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

PER_K_TOKENS = {"1": 8.0, "2": 4.0, "3": 2.0, "4": 1.0}
LABELS = ["Tool Definitions", "Messages", "Files", "Tool Results", "System Instructions"]


def unix_ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


class Testbed:
    """Lazily built DataFrames over one test data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def request(self) -> DataFrame:
        o = self.raw("orders")
        growth = 1 + (F.year("o_orderdate") - 1995) * 0.1
        prompt = F.floor(F.col("o_totalprice") * growth)
        digit = F.substring("o_orderpriority", 1, 1)
        per_k = F.coalesce(*[F.when(digit == d, F.lit(r)) for d, r in PER_K_TOKENS.items()])
        return o.select(
            F.col("o_orderkey").cast("string").alias("request_id"),
            F.col("o_custkey").cast("string").alias("session_id"),
            unix_ms("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("model"),
            prompt.alias("prompt_tokens"),
            (F.col("o_orderkey") % 500).alias("output_tokens"),
            F.when(F.col("o_orderkey") % 4 == 0, prompt / 1000.0 * per_k).alias("credits"),
            (F.datediff("o_orderdate", F.lit("1995-01-01")) * 8 + F.col("o_orderkey") % 8).alias(
                "turn_index"
            ),
            F.concat(
                F.lit("ws"), F.col("o_custkey") % 20, F.lit("/chatSessions/"), "o_custkey",
                F.lit(".jsonl"),
            ).alias("source_file"),
            (F.col("o_orderkey") * 100).alias("source_offset"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        call = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("string").alias("request_id"),
            call.alias("call_id"),
            F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("file"),
            "*",
        )

    @cached_property
    def cost_centre(self) -> DataFrame:
        label = F.element_at(
            F.array(*[F.lit(x) for x in LABELS]), (F.col("l_linenumber") % 5 + 1).cast("int")
        )
        price = F.col("l_extendedprice")
        # A request's labels are columns until it is joined, so that its lines are shuffled once.
        held = {x: F.col("_label").eqNullSafe(F.lit(x)) for x in [*LABELS, None]}
        per_request = self._lines.withColumn("_label", label).groupBy("request_id").agg(
            F.sum(price).alias("whole"),
            *[F.sum(F.when(own, price)).alias(f"_part{i}") for i, own in enumerate(held.values())],
            *[F.count(F.when(own, 1)).alias(f"_n{i}") for i, own in enumerate(held.values())],
        )
        parts = F.array(
            *[
                F.struct(F.lit(x).cast("string").alias("label"), F.col(f"_part{i}").alias("part"), F.col(f"_n{i}").alias("n"))
                for i, x in enumerate(held)
            ]
        )
        pct = F.col("part") * 100.0 / F.col("whole")
        return (
            per_request.join(self.request.select("request_id", "prompt_tokens"), "request_id")
            .select("request_id", "prompt_tokens", "whole", F.inline(parts))
            .where(F.col("n") > 0)
            .select(
                "request_id",
                F.lit("prompt").alias("category"),
                "label",
                pct.alias("percentage_of_prompt"),
                F.floor(pct / 100.0 * F.col("prompt_tokens") + 0.5).alias("tokens"),
            )
        )

    @cached_property
    def tool_call(self) -> DataFrame:
        flag = F.col("l_returnflag")
        ranged = F.col("l_quantity") >= 10
        line = F.col("l_linenumber").cast("long")
        return self._lines.select(
            "request_id",
            F.col("call_id").alias("round_id"),
            F.col("call_id").alias("tool_call_id"),
            F.when(
                F.col("l_partkey") % 200 == 0,
                F.concat(F.lit("mcp_vendor"), F.col("l_suppkey") % 5, F.lit("_lookup")),
            )
            .when(flag == "N", "read_file")
            .when(flag == "A", "replace_string_in_file")
            .otherwise("run_in_terminal")
            .alias("name"),
            F.when((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1), F.lit(400_000))
            .when(F.col("l_partkey") % 31 == 0, F.lit(None))
            .otherwise(F.col("l_quantity") * 100)
            .cast("long")
            .alias("result_chars"),
            F.when(flag != "R", F.col("file")).alias("target_file_hash"),
            F.when(ranged, line * 10).alias("target_start_line"),
            F.when(ranged, line * 10 + 15).alias("target_end_line"),
        )

    @cached_property
    def round(self) -> DataFrame:
        repeats = F.explode(F.sequence(F.lit(1), (F.col("l_orderkey") % 4 + 1).cast("int")))
        return self._lines.withColumn("rep", repeats).select(
            "request_id",
            F.concat_ws("-", "call_id", "rep").alias("round_id"),
            F.lit(0).cast("long").alias("ts"),
            F.when(F.col("rep") == 2, F.when(F.col("l_linenumber") == 2, "1-URGENT").otherwise("4-NOT SPECIFIED"))
            .alias("model_id"),
            F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") * 10)
            .cast("long")
            .alias("thinking_tokens"),
            F.lit(0).cast("long").alias("retries"),
        )

    @cached_property
    def edit(self) -> DataFrame:
        return (
            self._lines.where(F.col("l_returnflag") == "A")
            .repartition("request_id")  # joins on the request that follow need no other shuffle
            .groupBy("request_id", F.col("file").alias("file_hash"))
            .agg(
                F.count(F.lit(1)).alias("edit_count"),
                F.bool_or(F.col("l_linestatus") == "F").alias("done"),
            )
        )

    @cached_property
    def compaction(self) -> DataFrame:
        return (
            self._lines.where(F.col("l_quantity") > 45)
            .join(self.request.select("request_id", "model"), "request_id")
            .select(
                "request_id",
                F.col("call_id").alias("tool_call_round_id"),
                "model",
                F.col("l_linenumber").cast("long").alias("num_rounds"),
                (F.col("l_linenumber") * 1000).cast("long").alias("duration_ms"),
                F.when(F.col("l_linestatus") == "F", "Success").otherwise("cancelled").alias("outcome"),
                F.floor("l_extendedprice").alias("context_length_before"),
            )
        )

    @cached_property
    def content_reference(self) -> DataFrame:
        return self._lines.select(
            "request_id", F.concat(F.lit("f"), F.col("l_suppkey") % 50).alias("file_hash")
        ).repartition("request_id").distinct()

    @cached_property
    def tracked_commit_file(self) -> DataFrame:
        """A commit of every order, dated back by a month for each number of its file; five files are never committed."""
        number = F.col("l_partkey") % 45
        return self._lines.join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("request_id").alias("sha"),
            (unix_ms("o_orderdate") - number * 2_592_000_000).alias("ts"),
            F.lit(False).alias("is_merge"),
            F.concat(F.lit("f"), number).alias("path_hash"),
        ).distinct()

    @cached_property
    def commit(self) -> DataFrame:
        key = F.col("o_orderkey")
        parent = lambda back: (key - back).cast("string")
        return self.raw("orders").select(
            key.cast("string").alias("sha"),
            F.col("o_custkey").cast("string").alias("author_id"),
            unix_ms("o_orderdate").alias("ts"),
            F.when(key % 11 == 0, F.array(parent(1), parent(2), parent(7)))
            .otherwise(F.array(parent(1)))
            .alias("parents"),
            (key % 11 == 0).alias("is_merge"),
            F.when(key % 5 == 0, key % 1000).alias("pull_request"),
            F.when(key % 37 == 0, parent(37)).alias("reverts_sha"),
        )

    @cached_property
    def commit_file(self) -> DataFrame:
        return self._lines.groupBy(
            F.col("request_id").alias("sha"),
            F.concat(F.lit("p"), "l_partkey").alias("path_hash"),
        ).agg(
            F.sum("l_quantity").cast("long").alias("added"),
            F.sum(F.floor(F.col("l_quantity") * F.col("l_discount") * 10)).alias("deleted"),
        )

    @cached_property
    def survival(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_orderdate")
        return self.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_linestatus").alias("arm"),
            F.datediff("l_shipdate", "o_orderdate").cast("double").alias("duration"),
            (F.col("l_returnflag") == "R").alias("event"),
            F.col("l_quantity").alias("weight"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        period = F.floor(F.datediff("o_orderdate", F.lit("1995-01-01")) / 365)
        return (
            self.raw("orders")
            .groupBy(F.col("o_custkey").cast("string").alias("unit"), period.alias("period"))
            .agg(F.avg("o_totalprice").alias("outcome"))
        )

    @cached_property
    def cohort(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.cast("string").alias("unit"),
            F.when(key % 5 != 0, 2 + key % 3).alias("treated_at"),
        )

    @cached_property
    def roster(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("unit"),
            F.col("c_mktsegment").alias("team"),
            F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("pre_spend"),
        )

    @cached_property
    def question(self) -> DataFrame:
        return self.raw("events").select(
            F.concat_ws("-", "event_type", F.floor(F.col("value") / 5)).alias("question_hash"),
            F.col("user_id").cast("string").alias("asked_by"),
            F.col("value").alias("credits"),
            unix_ms("ts").alias("ts"),
        )
