"""Ranked lexical search over an inverted index stratified by document length.

A document's length enters its scores only through the normaliser m, a small integer. Documents of equal m
form a stratum, cut into pieces of at most `PIECE` documents. Within a piece the postings of a term are
grouped by tf, so an impact is computed once for each tf and holds for all its documents. The largest
impact of each of an item's terms bounds what any document of the piece can score; pieces are visited by
falling bound, until the bound is below the score of the last place. Equal bounds are still visited, as
ties go to the smaller doc_id.

The index is a table: one row for each (piece, term, tf), and one directory row for each piece, which has
the doc_ids of its slots. Pieces of a task are searched by themselves; their best rows meet in one window
per item that keeps `k` rows on each side of the shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PIECE = 4096
# Documents, pieces and postings that are searched together by one task.
GROUP_DOCUMENTS, GROUP_PIECES, PIECE_POSTINGS = 16_384, 64, 2_000_000
BLOCK_BYTES = 16 << 20
FORWARD = "row long, doc_id long, n long, terms array<string>, tfs array<int>"
INDEX = "`group` long, piece int, m long, term string, tf int, slots array<int>, doc_ids array<long>"
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (A-Z lower-cased) and characters past ASCII."""
    return text.translate(_FOLD).split()


def _tokenize(batches):
    for batch in batches:
        counts = [Counter(terms_of(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.cumsum([0, *map(len, counts)]).astype(np.int32)
        terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
        tfs = pa.array([n for c in counts for n in c.values()], pa.int32())
        columns = [
            batch.column("row"), batch.column("doc_id"), pa.array([c.total() for c in counts], pa.int64()),
            pa.ListArray.from_arrays(sizes, terms), pa.ListArray.from_arrays(sizes, tfs),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "terms", "tfs"])


def _concat(arrays: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(arrays).flatten()


class _Piece:
    """Documents of one stratum, gathered until the piece is full."""

    def __init__(self, m: int) -> None:
        self.m, self.ids, self.sizes, self.terms, self.tfs, self.held = m, [], [], [], [], 0

    def rows(self, group: int, piece: int) -> pa.RecordBatch:
        coded = _concat(self.terms).dictionary_encode()
        codes, tfs = coded.indices.to_numpy(), _concat(self.tfs).to_numpy()
        slots = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.lexsort((slots, tfs, codes))
        codes, tfs, slots = codes[order], tfs[order], slots[order]
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (tfs[1:] != tfs[:-1])])
        n = len(starts) + 1  # the last row is the directory
        lists = pa.ListArray.from_arrays(np.r_[starts, len(codes), len(codes)].astype(np.int32), pa.array(slots))
        directory = pa.array([None] * (n - 1) + [self.ids], pa.list_(pa.int64()))
        columns = [
            pa.array(np.full(n, group)), pa.array(np.full(n, piece, np.int32)), pa.array(np.full(n, self.m)),
            pa.concat_arrays([coded.dictionary.take(pa.array(codes[starts])), pa.nulls(1, pa.string())]),
            pa.array(np.r_[tfs[starts], 0].astype(np.int32)), lists, directory,
        ]
        return pa.RecordBatch.from_arrays(columns, ["group", "piece", "m", "term", "tf", "slots", "doc_ids"])


def _cut(batches):
    """Index rows of a partition that is sorted by m."""
    base = TaskContext.get().partitionId() << 32
    group = number = documents = 0
    open_piece = None
    for batch in batches:
        ms = batch.column("m").to_numpy()
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        at = 0
        while at < len(ms):
            if open_piece is None:
                open_piece = _Piece(int(ms[at]))
            same = len(ms) if ms[-1] == open_piece.m else int(np.searchsorted(ms, open_piece.m, "right"))
            postings = np.searchsorted(np.cumsum(sizes[at:same]), PIECE_POSTINGS - open_piece.held, "right")
            end = min(same, at + PIECE - len(open_piece.ids), at + max(int(postings), 0 if open_piece.ids else 1))
            if end > at:
                open_piece.ids += batch.column("doc_id").slice(at, end - at).to_pylist()
                open_piece.sizes += sizes[at:end].tolist()
                open_piece.held += int(sizes[at:end].sum())
                open_piece.terms.append(batch.column("terms").slice(at, end - at))
                open_piece.tfs.append(batch.column("tfs").slice(at, end - at))
                at = end
            if at < len(ms):  # the next document does not go in
                if documents + len(open_piece.ids) > GROUP_DOCUMENTS or number == GROUP_PIECES:
                    group, number, documents = group + 1, 0, 0
                yield open_piece.rows(base + group, number)
                number, documents, open_piece = number + 1, documents + len(open_piece.ids), None
    if open_piece is not None:
        if documents + len(open_piece.ids) > GROUP_DOCUMENTS or number == GROUP_PIECES:
            group, number = group + 1, 0
        yield open_piece.rows(base + group, number)


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index of `docs` (doc_id, text; other columns are not read) and the number of documents in it.

    Documents without terms (null, empty or only delimiters) are not indexed. Rows that repeat an id or a
    text are documents of their own. An empty table gives an empty index.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    forward = written(narrow.mapInArrow(_tokenize, FORWARD)).where("n > 0")
    total = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n, words = total["n"], max(1, total["words"])
    stratum = F.lit(50) + F.expr(f"(50 * n * {n}L) div {words}L")
    ordered = forward.withColumn("m", stratum).drop("n").repartitionByRange("m", "row").sortWithinPartitions("m", "row")
    return written(ordered.mapInArrow(_cut, INDEX)), n


def _searcher(held, k: int):
    def best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray):
        order = np.lexsort((ids, known, -scores))[:k]
        return ids[order], known[order], scores[order]

    def search(table: pa.Table) -> pa.Table:
        starts, flat, weights = held.value
        pieces: dict[int, tuple] = {}
        directory = table.filter(pa.compute.is_valid(table["doc_ids"]))
        for piece, ids in zip(directory["piece"].to_pylist(), directory["doc_ids"].to_pylist(), strict=True):
            known = np.array([i is not None for i in ids])
            pieces[piece] = (np.array([i or 0 for i in ids], np.int64), known, {})
        postings = table.filter(pa.compute.is_null(table["doc_ids"])).combine_chunks().sort_by([("piece", "ascending"), ("term_no", "ascending")])
        of, terms, tfs, ms = (postings[c].to_numpy() for c in ("piece", "term_no", "tf", "m"))
        lists = postings["slots"].combine_chunks()
        slots, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        impacts = 1_000_000_000 * tfs.astype(np.int64) // (1000 * tfs.astype(np.int64) + 20 * ms)
        gains, ends = np.repeat(impacts * weights[terms], sizes), np.r_[0, np.cumsum(sizes)]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (terms[1:] != terms[:-1])]) if len(of) else np.array([], int)
        numbers = sorted(pieces)
        most = np.zeros((len(numbers), len(weights)), np.int64)
        place = {p: i for i, p in enumerate(numbers)}
        for a, b in zip(first, np.r_[first[1:], len(of)], strict=True):
            p, t = int(of[a]), int(terms[a])
            span = slice(ends[a], ends[b])
            pieces[p][2][t] = (slots[span], gains[span])
            most[place[p], t] = gains[span].max()
        sums = np.concatenate([np.zeros((len(numbers), 1), np.int64), np.cumsum(most[:, flat], axis=1)], axis=1)
        bounds = sums[:, starts[1:]] - sums[:, starts[:-1]]
        out = []
        for item in range(len(starts) - 1):
            found = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
            for i in np.argsort(-bounds[:, item], kind="stable"):
                last = found[2][-1] if len(found[2]) == k else 1
                if bounds[i, item] < last:
                    break
                ids, known, held_terms = pieces[numbers[i]]
                score = np.zeros(len(ids), np.int64)
                for t in flat[starts[item] : starts[item + 1]].tolist():
                    if t in held_terms:
                        at, gain = held_terms[t]
                        score[at] += gain
                hit = np.flatnonzero(score >= last)
                if len(hit):
                    found = best(*(np.concatenate(x) for x in zip(found, (ids[hit], known[hit], score[hit]), strict=True)))
            out.append(pa.table({
                "item_no": pa.array(np.full(len(found[0]), item, np.int64)),
                "doc_id": pa.array(found[0], mask=~found[1]), "score": pa.array(found[2]),
            }))
        return pa.concat_tables(out)

    return search


def search(index: DataFrame, n: int, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents with a score above 0 for each row of `items` (item_id, text).

    `index` and `n` come from `build_index`. Equal scores rank by doc_id, nulls first. Items that are null or
    without terms find nothing; rows that repeat an item are one if they agree in id and text, else ranked each
    by itself. The index is searched once for each BLOCK_BYTES of item texts.
    """
    spark = items.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        sets = [(r["item_id"], sorted({t.decode() for t in terms_of(r["text"].encode())})) for r in own]
        sets = [(i, s) for i, s in sets if s]
        vocabulary = sorted({t for _, s in sets for t in s})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        named = spark.createDataFrame([*numbers.items()], "term string, term_no long")
        # The words of BLOCK_BYTES of text at most; broadcast, so that the index is filtered where it is read.
        postings = index.where("term IS NOT NULL").join(F.broadcast(named), "term")
        df = postings.groupBy("term_no").agg(F.sum(F.size("slots")).alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(max(1, len(vocabulary)), np.int64)
        for r in df.select("term_no", weight.cast("long").alias("w")).collect():
            weights[r["term_no"]] = r["w"]
        starts = np.cumsum([0, *(len(s) for _, s in sets)])
        flat = np.array([numbers[t] for _, s in sets for t in s], np.int64)
        held = spark.sparkContext.broadcast((starts, flat, weights))
        directory = index.where("term IS NULL").withColumn("term_no", F.lit(-1).cast("long"))
        parts = postings.unionByName(directory).drop("term")
        found = parts.groupBy("group").applyInArrow(_searcher(held, k), "item_no long, doc_id long, score long")
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(sets)], "item_no long, item_id long")
        best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked = ranked.join(ids, "item_no").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
