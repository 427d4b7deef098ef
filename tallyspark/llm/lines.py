"""Repeated runs of lines, found by prefix doubling over line names; only DataFrame functions.

The lines of all documents form one sequence in the order of documents. A line that occurs once ends
every repeated run, so only stretches of repeated lines with enough words are kept (segments). Doubling
names each block of 2^k lines by its two halves, so that the suffixes that share a prefix, an LCP interval,
are those with equal names of that prefix.

A run is deleted if it has `min_words` words and an earlier copy. Two depths per line decide that for runs
of any length: the shortest prefix with enough words of the suffix that begins at the line, and the same
backwards for what ends at it. A line lies in a run to be deleted exactly if one of these windows that hold
it has an earlier copy: either enough words of the run end at the line, and its backward window lies in the
run; or they do not, and the forward window of the run's first line reaches past it. Equal windows have
equal lengths and names wherever they stand, so one grouped minimum finds the first copy of each.

Blocks never leave their document. The global step is a grouped minimum, pre-aggregated, and an equality
join that adaptive execution can split where one window is very common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .sharding import row_numbers


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _name(*parts: Column) -> list[Column]:
    """A 128-bit name of its parts."""
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b")]


def segments(docs: DataFrame, min_words: int) -> DataFrame:
    """Stretches of lines that all occur more than once in the corpus, with `min_words` words at least.

    Returns doc_id, text_hash, first (line number), lines: array of (i, a, b, w), n.
    """
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("text_hash"), F.posexplode(F.split(_text(), "\n")).alias("i", "line"))
    named = lines.select("doc_id", "text_hash", "i", *_name(F.col("line")), F.regexp_count("line", F.lit(r"\S+")).alias("w"))
    repeated = named.groupBy("a", "b").count().where("count > 1").drop("count")
    common = named.join(repeated, ["a", "b"])
    # Neighbouring lines differ equally in number and rank. Rows that repeat an id and text are one document.
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "text_hash").orderBy("i"))
    stretch = common.withColumn("g", F.col("i") - rank).groupBy("doc_id", "text_hash", "g")
    found = stretch.agg(F.array_sort(F.collect_set(F.struct("i", "a", "b", "w"))).alias("lines"))
    words = F.aggregate("lines", F.lit(0), lambda s, x: s + x["w"])
    return found.where(words >= min_words).select(
        "doc_id", "text_hash", F.col("lines")[0]["i"].alias("first"), "lines", F.size("lines").alias("n")
    )


def _doubled(level: Column, step: int) -> Column:
    """Blocks of twice the length, from blocks of `step` lines."""
    starts = F.when(F.size(level) > step, F.sequence(F.lit(0), F.size(level) - step - 1)).otherwise(F.array().cast("array<int>"))

    def pair(i):
        x, y = level[i], level[i + step]
        return F.struct(*_name(x["a"], x["b"], y["a"], y["b"]), (x["w"] + y["w"]).alias("w"))

    return F.transform(starts, pair)


def _window(levels: Column, top: int, i: Column, min_words: int) -> Column:
    """Name and length of the shortest block at i with enough words; its name is null where none is long enough."""
    sizes = F.array(*[F.lit(1 << k) for k in range(top + 1)])
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("w"), i.alias("at"))

    def grown(acc, k):
        x = F.get(levels[k], acc["at"])
        return F.struct(*_name(acc["a"], acc["b"], x["a"], x["b"]), (acc["w"] + x["w"]).alias("w"), (acc["at"] + sizes[k]).alias("at"))

    def below(acc, k):
        short = F.coalesce(acc["w"] + F.get(levels[k], acc["at"])["w"] < min_words, F.lit(False))
        return F.when(short, grown(acc, k)).otherwise(acc)

    # The longest block that is too short, then one line more.
    return F.aggregate(F.sequence(F.lit(top), F.lit(0), F.lit(-1)), start, below, lambda acc: grown(acc, F.lit(0)))



def windows(found: DataFrame, min_words: int) -> DataFrame:
    """Forward and backward windows of every line of the segments: doc_id, text_hash, low, high, a, b, pos."""
    placed = row_numbers(found, ["doc_id", "text_hash", "first"], "__pos", "n")
    longest = placed.agg(F.max("n").alias("n")).first()["n"] or 1
    top = longest.bit_length() - 1
    both = []
    for backward in (False, True):
        lines = F.reverse("lines") if backward else F.col("lines")
        table = placed.withColumn("l0", F.transform(lines, lambda x: F.struct(x["a"], x["b"], x["w"])))
        for k in range(top):
            table = table.withColumn(f"l{k + 1}", _doubled(F.col(f"l{k}"), 1 << k))
        levels = F.array(*[F.col(f"l{k}") for k in range(top + 1)])
        every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _window(levels, top, i, min_words))
        rows = table.select("doc_id", "text_hash", "first", "n", "__pos", F.posexplode(every).alias("i", "x")).where("x.w IS NOT NULL")
        low = F.col("n") - F.col("x.at") if backward else F.col("i")
        high = F.col("n") - 1 - F.col("i") if backward else F.col("x.at") - 1
        both.append(
            rows.select(
                "doc_id", "text_hash", (F.col("first") + low).alias("low"), (F.col("first") + high).alias("high"),
                F.xxhash64("x.a", F.lit(backward)).alias("a"), F.col("x.b").alias("b"), (F.col("__pos") + low).alias("pos"),
            )
        )
    return both[0].union(both[1])


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text_hash, removed: the line numbers of each document that lie in a later copy of a run.

    A run is a row of whole lines within one document with `min_words` words at least; it is a later copy
    if the same run stands earlier, in an earlier document (by doc_id, nulls first, then by text) or above
    in the same one. Overlapping copies are joined. Rows that repeat an id and text are one document.
    """
    asked = written(windows(segments(docs, min_words), min_words))
    first = asked.groupBy("a", "b").agg(F.min("pos").alias("first"))
    copied = asked.join(first, ["a", "b"]).where("first < pos").select("doc_id", "text_hash", "low", "high")
    # Windows that add nothing to those that begin before them are left out, the others are cut to what they add.
    before = Window.partitionBy("doc_id", "text_hash").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("low", F.coalesce(F.max("high").over(before) + 1, F.col("low")))
    fresh = copied.withColumn("begin", begin).where("high >= begin")
    ranges = fresh.select("doc_id", "text_hash", F.sequence("begin", "high").alias("lines"))
    return ranges.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("removed"))


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, removed: str = "removed") -> DataFrame:
    """All rows and columns of `docs` with later copies cut out of `text`; see `repeated_lines`.

    Adds the column named by `removed` (line numbers, empty where nothing was cut). A null text stays null, a text of which
    nothing is left becomes empty.
    """
    gone = written(repeated_lines(docs, min_words)).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__removed")
    )
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(_text()) == gone["__hash"])
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n"))
    # Texts are shuffled once; a plan that broadcasts what was cut from a small corpus would not hold for a large one.
    out = docs.drop(removed).join(gone.hint("merge"), same, "left")
    return out.withColumns({"text": text, removed: F.coalesce("__removed", F.array().cast("array<int>"))}).drop("__id", "__hash", "__removed")
