"""A store of the normalised tables: replacing per request, scans by day, look-ups by request.

Requests lie under the span of days they fall in (one day, unless there are few a day), the other tables under a hash
bucket of the request. Every batch only adds files; its
rows carry the batch's name. The look-up table has one narrow row per request and batch and is written last: rows of
a batch that it does not name are not seen, so a batch that breaks off leaves the store as it was. The newest batch
that names a request owns it, with all its children; earlier rows stay unseen until `compact`. One writer at a time.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import materialise

#: Requests of one bucket of the look-up table, whose file then takes some tens of MB.
BUCKET_ROWS = 1_000_000
LOOKUP, LAYOUT = "request_location", "layout"
BATCH, VERSION, SPAN, BUCKET = "store_batch", "store_version", "store_span", "store_bucket"
LOCATION = f"request_id string, ts long, source_file string, source_offset long, {VERSION} long, {BATCH} string"
DAY_MS = 86_400_000


def _bucket(request_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(request_id), F.lit(buckets)).cast("int")


def _span(ms: Column, days: int) -> Column:
    """Number of the span of UTC days that holds a time."""
    return F.floor(ms / (days * DAY_MS)).cast("int")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of all batches; the columns are named, as a table may have no file yet."""
    columns = LOCATION if name == LOOKUP else _columns(name) + f", {BATCH} string"
    return spark.read.schema(f"{columns}, {SPAN if name == 'request' else BUCKET} int").parquet(f"{root}/{name}")


def _columns(name: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TABLES[name])


def _append(rows: DataFrame, root: str, name: str, layout: Row) -> None:
    """One file per bucket, or for requests per span and task, sorted, with a Bloom filter on the request."""
    rows = rows.withColumn(BUCKET, _bucket(F.col("request_id"), layout["buckets"]))
    if name == "request":  # by bucket as well, so that no span is one task's
        rows = rows.withColumn(SPAN, _span(F.col("ts"), layout["span_days"])).repartition(SPAN, BUCKET).drop(BUCKET)
        key = SPAN
    else:
        rows, key = rows.repartition(BUCKET), BUCKET
    (
        rows.sortWithinPartitions(key, "request_id")
        .write.mode("append")
        .partitionBy(key)
        .option("parquet.bloom.filter.enabled#request_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(f"{root}/{name}")
    )


def create(tables: dict[str, DataFrame], root: str, buckets: int | None = None, span_days: int = 1) -> None:
    """A new store of `request` and any other tables; a request twice in them stays twice.

    The number of buckets follows the requests and stays; `compact` into a new store chooses it anew.
    Requests without a time lie under the null span and are in no range of days.
    """
    spark = tables["request"].sparkSession
    if buckets is None:
        buckets = max(1, -(-tables["request"].count() // BUCKET_ROWS))
    layout = spark.createDataFrame([(buckets, span_days)], "buckets int, span_days int").coalesce(1)
    layout.write.parquet(f"{root}/{LAYOUT}")
    _add(tables, root, 1)


def _layout(spark: SparkSession, root: str) -> Row:
    return spark.read.parquet(f"{root}/{LAYOUT}").first()


def _add(tables: dict[str, DataFrame], root: str, version: int) -> None:
    layout = _layout(tables["request"].sparkSession, root)
    batch = F.lit(uuid4().hex)
    requests = materialise(tables["request"])  # read by its own table and the look-up: both must see the same rows
    named = {"request": requests, **{n: t for n, t in tables.items() if n != "request"}}
    for name, rows in named.items():
        _append(rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[name]]).withColumn(BATCH, batch), root, name, layout)
    places = requests.groupBy("request_id").agg(
        F.max_by(F.struct("ts", "source_file", "source_offset"), F.struct("source_file", "source_offset")).alias("at")
    )
    places = places.select("request_id", "at.*").withColumn(VERSION, F.lit(version).cast("long")).withColumn(BATCH, batch)
    _append(places, root, LOOKUP, layout)


def replace(tables: dict[str, DataFrame], root: str) -> None:
    """Requests of `tables` take the place of stored ones of the same id, with all their children."""
    spark = tables["request"].sparkSession
    last = _read(spark, root, LOOKUP).agg(F.max(VERSION)).first()[0]
    _add(tables, root, (last or 0) + 1)


def _newest(rows: DataFrame) -> DataFrame:
    """request_id and the batch that owns it; narrow rows, one per request."""
    return rows.groupBy("request_id").agg(F.max_by(BATCH, VERSION).alias(BATCH))


def scan(spark: SparkSession, root: str, name: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Current rows of a table, those of `request` from `since_ms` to before `until_ms`; only those days' folders are opened."""
    rows, days = _read(spark, root, name), _layout(spark, root)["span_days"]
    if (since_ms, until_ms) != (None, None) and name != "request":
        raise ValueError(f"{name} has no days")
    if since_ms is not None:
        rows = rows.where((F.col(SPAN) >= _span(F.lit(since_ms), days)) & (F.col("ts") >= since_ms))
    if until_ms is not None:
        rows = rows.where((F.col(SPAN) <= _span(F.lit(until_ms), days)) & (F.col("ts") < until_ms))
    newest = _newest(_read(spark, root, LOOKUP))
    return rows.join(newest, ["request_id", BATCH], "left_semi").select(*schemas.TABLES[name].fieldNames())


def _places(spark: SparkSession, root: str, request_id: str) -> DataFrame:
    bucket = _bucket(F.lit(request_id), _layout(spark, root)["buckets"])
    return _read(spark, root, LOOKUP).where((F.col(BUCKET) == bucket) & (F.col("request_id") == request_id))


def locate(spark: SparkSession, root: str, request_id: str) -> DataFrame:
    """request_id, source_file, source_offset and ts of one request; opens the files of one bucket, one after compaction."""
    at = F.max_by(F.struct("source_file", "source_offset", "ts"), VERSION)
    return _places(spark, root, request_id).groupBy("request_id").agg(at.alias("at")).select("request_id", "at.*")


def fetch(spark: SparkSession, root: str, name: str, request_id: str) -> DataFrame:
    """Current rows of one request in a table: of `request` only its span is opened, of others only its bucket."""
    layout = _layout(spark, root)
    newest = F.max_by(F.struct("ts", BATCH), VERSION)
    owner = _places(spark, root, request_id).agg(newest.alias("at"))
    rows = _read(spark, root, name).where(F.col("request_id") == request_id)
    rows = rows.where(F.col(BATCH) == owner.select(f"at.{BATCH}").scalar())
    if name == "request":
        rows = rows.where(F.col(SPAN).eqNullSafe(owner.select(_span(F.col("at.ts"), layout["span_days"])).scalar()))
    else:
        rows = rows.where(F.col(BUCKET) == _bucket(F.lit(request_id), layout["buckets"]))
    return rows.select(*schemas.TABLES[name].fieldNames())


def compact(spark: SparkSession, root: str, names: list[str], target: str) -> None:
    """A new store at `target` with the current rows of the named tables (`request` among them) alone."""
    create({name: scan(spark, root, name) for name in names}, target, span_days=_layout(spark, root)["span_days"])
