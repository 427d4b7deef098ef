"""Reads that fetch lines the session has already been given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.intervals import TOP, clipped, first_overlapping, levels_for
from ...functions.ordered import latest_before
from ...session import materialise
from ..corpus import Corpus

#: Most reads of one session and file that are compared with each other directly.
FEW = 64


def scan_rereads(corpus: Corpus) -> DataFrame:
    """Read calls overlapping an earlier read of the same session and file.

    `duplicate` means some such earlier read is no older than the last edit of the file;
    otherwise the file was refreshed. "Earlier" follows call order, the edit comparison
    follows time. Two reads fall in the same edit epoch exactly when their last edit is
    the same, so the test is a smallest-place look-up among overlapping ranges, once
    within the epoch and once over the whole session. Files with few reads in a session are
    told where their reads meet; the others by blocks of lines, without comparing pairs.
    """
    by = corpus.by
    keys = [*by, "session_id", "file_hash"]
    reads = corpus.read_calls
    # A file read once in a session cannot be re-read.
    finite = F.greatest(F.col("start"), F.when(F.col("end") < TOP, F.col("end")))
    often = (
        reads.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(finite).alias("_reach"),
            F.bool_and(F.col("start") <= F.col("end")).alias("_proper"),
        )
        .where(F.col("_n") > 1)
        .withColumn("few", (F.col("_n") <= FEW) & F.col("_proper"))
    )
    reads = (
        reads.join(often.drop("_n", "_proper"), keys)
        .withColumn("end", clipped(F.col("end"), F.col("_reach")))
        .withColumn("levels", levels_for(F.col("_reach")))
        .drop("_reach")
    )
    request = corpus.request.select(*by, "request_id", "session_id", "ts")
    edits = corpus.edit.join(request, [*by, "request_id"]).select(*keys, "ts")
    edits = edits.join(often, keys, "left_semi")
    # Written once: the ranges and the final marking both read it.
    reads = materialise(
        latest_before(reads, edits, keys, "ts", "last_edit").withColumn(
            "epoch", F.coalesce("last_edit", F.lit(-1).cast("long"))
        )
    )
    columns = [*by, "request_id", "session_id", "file_hash", "place", "chars"]
    place = F.col("place")
    met = F.collect_list(F.struct("epoch", "start", "end", "place")).over(Window.partitionBy(*keys))

    def earlier(also):
        return F.exists(
            "_met",
            lambda o: also(o) & (o["start"] <= F.col("end")) & (o["end"] >= F.col("start")) & (o["place"] < place),
        )

    direct = reads.where("few").withColumn("_met", met).where(earlier(lambda o: F.lit(True)))
    direct = direct.select(*columns, earlier(lambda o: o["epoch"] == F.col("epoch")).alias("duplicate"))
    reads = reads.where(~F.col("few"))
    ranges = reads.groupBy(*keys, "epoch", "start", "end", "levels").agg(F.min("place").alias("place"))
    first = first_overlapping(
        ranges, keys, "epoch", "start", "end", "place", "first_in_epoch", "first_ever", "levels"
    )
    marked = reads.join(first, [*keys, "epoch", "start", "end"])
    many = marked.where(F.col("first_ever") < place).select(
        *columns, (F.col("first_in_epoch") < place).alias("duplicate")
    )
    return direct.unionByName(many)
