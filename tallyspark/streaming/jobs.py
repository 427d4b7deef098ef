"""Running the streams: sinks, and repeated journal ingest into a store."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, checkpoint_dir, materialise, written
from ..sources import journals, normalise, store

MANIFEST = "file_path string, mtime_ms long, size_bytes long, content_hash string, last_ingested_at long"
LINE_COUNTS = ("total_lines", "malformed_lines", "unrecognised_envelopes")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now and stop.

    Append streams go to Parquet files whose commit log makes a retried batch count once;
    other modes replace the table with each batch.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = writer.outputMode(mode).foreachBatch(replace).start()
    query.awaitTermination()


def collect_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a bounded stream into the shared folder and return what it wrote."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    run_available(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def ingest_journals(
    spark: SparkSession, roots: list[str], store_root: str, salt: str, now_ms: int | None = None, verify: bool = False
) -> DataFrame:
    """Read new or grown journal files under `roots` into the store; returns the batch's summary row.

    Spark's streaming file source never reads a path twice, and journals grow in place, so each run lists the
    folder and compares times and sizes with the manifest; only files that differ are opened, in byte ranges, up
    to the length that was listed. With `verify`, the others are read too and their lines' hashes compared.
    """
    number, state = _begin(spark, store_root)
    listed = materialise(journals.list_journals(spark, roots))
    fresh = materialise(journals.changed_files(listed, state))
    if verify:
        same = listed.join(fresh.select("path"), "path", "left_anti")
        known = state.select(F.col("file_path").alias("path"), F.col("content_hash").alias("known"))
        now = same.join(journals.fingerprints(_lines_of(spark, same)), "uri", "left").join(known, "path")
        differ = now.where(~F.col("content_hash").eqNullSafe(F.col("known"))).select(listed.columns)
        fresh = materialise(fresh.unionByName(differ))
    lines = materialise(_lines_of(spark, fresh))
    hashed = fresh.join(journals.fingerprints(lines), "uri", "left")
    named = lines.join(fresh.select("uri", "path"), "uri").select("path", "offset", "line")
    return _ingest(listed, hashed, named, store_root, number, salt, now_ms)


def _lines_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Lines of listed files, without what was appended since."""
    # Names of files, which Spark's reader takes as a list on the driver and lists again there.
    lines = journals.read_lines(spark, [r["path"] for r in files.select("path").collect()])
    whole = F.col("offset") + F.octet_length("line") <= F.col("length")
    return lines.join(files.select("uri", "length"), "uri").where(whole).drop("length")


def ingest_files(files: DataFrame, store_root: str, salt: str, now_ms: int | None = None) -> DataFrame:
    """Bring files that differ from the manifest, or in their hash, into the store; returns the batch's summary row.

    `files` has path, modificationTime, length and content. Changed files are read whole, once, into the
    shared folder: what the manifest records is what was parsed, even if a file grows meanwhile.
    """
    number, state = _begin(files.sparkSession, store_root)
    fresh = written(journals.incremental_files(files, state))
    return _ingest(files, fresh, journals.split_lines(fresh), store_root, number, salt, now_ms)


def _begin(spark: SparkSession, store_root: str) -> tuple[int, DataFrame]:
    """The next batch's number and the newest state of every file."""
    done = commits(spark, store_root)
    if done is None:
        return 0, spark.createDataFrame([], MANIFEST)
    last = done.agg(F.max("batch")).first()[0]
    manifest = spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{store_root}/manifest").where(F.col("batch") <= last)
    return last + 1, _newest_state(manifest)


def _ingest(
    files: DataFrame, fresh: DataFrame, lines: DataFrame, store_root: str, number: int, salt: str, now_ms: int | None
) -> DataFrame:
    """Write one batch. Every request of a changed file replaces its older version.

    The commit row is written last, also for a batch without files: a run that fails before that leaves nothing
    visible, and the next one takes its number and overwrites its files. One writer at a time.
    """
    spark = files.sparkSession
    envelopes = written(journals.parse_envelopes(lines))
    sessions = journals.session_ids(envelopes)
    # Each child table below reads its own columns of them.
    rows = written(normalise.normalise_requests(journals.replay_journal(envelopes, sessions), sessions, salt))
    good = normalise.good(rows)
    for name, table in normalise.child_tables(good, salt).items():
        _write(table.withColumn("version", store.version_of(number)), store_root, name, number)
    stats, drift = journals.journal_stats(envelopes), normalise.all_drift(rows, sessions, fresh)
    _write(stats, store_root, "journal_stats", number)
    _write(drift, store_root, "quarantine", number)
    one = F.count(F.lit(1))
    summary = files.agg(one.alias("files_considered"))
    for part in (
        fresh.agg(one.alias("files_ingested")),
        good.agg(one.alias("requests")),
        drift.agg(one.alias("quarantined")),
        stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LINE_COUNTS]),
    ):
        summary = attach(summary, part)
    summary = summary.withColumn("files_skipped", F.col("files_considered") - F.col("files_ingested"))
    _write(summary, store_root, "summary", number)
    now_ms = time.time_ns() // 1_000_000 if now_ms is None else now_ms
    _write(journals.ingested_state(fresh, now_ms), store_root, "manifest", number)
    _write(spark.range(1).select(F.lit(now_ms).cast("long").alias("committed_at")), store_root, "commit", number)
    return spark.read.parquet(f"{store_root}/summary").where(F.col("batch") == number)


def _write(table: DataFrame, store_root: str, name: str, number: int) -> None:
    table.write.mode("overwrite").parquet(f"{store_root}/{name}/batch={number}")


def commits(spark: SparkSession, store_root: str) -> DataFrame | None:
    """One row per committed batch: batch, committed_at; None before the first."""
    try:
        return spark.read.schema("committed_at long, batch long").parquet(f"{store_root}/commit")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest_state(manifest: DataFrame) -> DataFrame:
    """The last recorded state of each file: one that returns to an older state counts as changed."""
    state = F.struct("mtime_ms", "size_bytes", "content_hash", "last_ingested_at")
    return manifest.groupBy("file_path").agg(F.max_by(state, "batch").alias("s")).select("file_path", "s.*")


def read_batches(spark: SparkSession, store_root: str, name: str) -> DataFrame:
    """Rows of a store table from committed batches, with their `batch`."""
    last = commits(spark, store_root).agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{store_root}/{name}").where(F.col("batch") <= last)


def read_current(spark: SparkSession, store_root: str, name: str) -> DataFrame:
    """Rows of the newest version of every request in an ingest store."""
    latest = store.latest_versions(read_batches(spark, store_root, "request").drop("batch"))
    if name == "request":
        return latest
    return store.surviving_children(read_batches(spark, store_root, name).drop("batch"), latest)
