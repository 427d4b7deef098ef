"""Benchmark decontamination: windows of a document within a small edit distance of a benchmark item.

Words are embedded by a CGK random walk, which repeats each word a random number of times, so that few
edits between two passages become few differing places. Some places of the walk are sampled (bit sampling);
windows and items that agree on a sample are candidates. Walks are repeated, for items of similar length
together, until edited copies of these items are found at the target recall. Each candidate is settled by
its exact edit distance in words. Items that the walks do not find at that recall are settled exactly in
every window that can hold them.

A window that matches keeps all of an item's words but the allowed edits, near their places. Windows that do
not are never walked, which is exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

WORD = re.compile(r"\w+")
#: Places sampled of a walk; share of edited copies to be found; walks at most, beyond which windows are settled exactly.
PLACES = 2
RECALL = 0.999
MOST_WALKS = 48
#: Edited copies on which the recall of a length is measured; items are of one length within this factor.
TRIES = 2_000
BIN = 1.25
#: Votes of words for windows that are sorted at once; more items than that take turns.
VOTES = 8_000_000
#: Benchmark text handled in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
#: Items of fewer words are found as exact runs of words only.
SHORTEST = 5
#: Documents searched at once; the share of their words below which a word is rare; least rare words to go by.
DOCUMENTS = 500
RARE = 3e-4
LEAST = 3
#: Room for the places of one item among the sorted votes: words at once, and items' lengths before the first.
SPAN, MARGIN = 1 << 40, 1 << 20


def normalised(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


def allowance(n: int, share: float) -> int:
    """Edits allowed in an item of n words."""
    return int(share * n + 1e-9)


def walk(seed: int, steps: int) -> np.ndarray:
    """A multiplier for each step; with a symbol's hash it decides between a step onward and a stay."""
    return mix(np.arange(steps, dtype=np.uint64) + (np.uint64(seed + 1) << np.uint64(32))) | np.uint64(1)


def hashes(ids: np.ndarray, pad: int) -> np.ndarray:
    """64-bit hashes of symbols, followed by `pad` unknown ones (symbol 0)."""
    return mix(np.concatenate([ids, np.zeros(pad, np.int64)]).astype(np.uint64) + np.uint64(1))


def sampled(symbols: np.ndarray, starts: np.ndarray, steps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key of the symbols at the sampled places of the walk from each start.

    `symbols` are padded beyond the last start by the walk's length.
    """
    at = starts.astype(np.int64)
    key = np.full(len(at), 1, np.uint64)
    wanted = set(places.tolist())
    for j in range(int(places[-1]) + 1):
        symbol = symbols[at]
        if j in wanted:
            key = mix(key ^ symbol)
        at = at + ((symbol * steps[j]) >> np.uint64(63)).astype(np.int64)
    return key


def edited(ids: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many words, at any places, replaced by unknown ones, deleted or preceded by unknown ones."""
    out = ids.tolist()
    for kind in rng.integers(3, size=edits).tolist():
        at = int(rng.integers(len(out)))
        if kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at : at + (kind == 0)] = [0]
    return np.array(out, np.int64)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any part of the text, and where that part ends."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for i, symbol in enumerate(item, 1):
        best = np.minimum(row[:-1] + (text != symbol), row[1:] + 1)
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - ramp) + ramp  # insertions from the left
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Items of one block: their vocabulary, where each word stands in them, and the keys of their walks."""

    def __init__(self, items: list[tuple[int, str | None]], share: float, seed: int = 11) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            found = normalised(text)
            if found:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
                self.items.append((item_id, np.array(ids, np.int64)))
        order = sorted((w, i, o) for i, (_, ids) in enumerate(self.items) for o, w in enumerate(ids.tolist()))
        self.postings = tuple(np.array(order, np.int64).reshape(-1, 3).T)
        self.lengths = np.array([len(ids) for _, ids in self.items], np.int64)
        self.edits = np.array([allowance(n, share) if n >= SHORTEST else 0 for n in self.lengths], np.int64)

        self.bins = []
        self.bin_of = (np.log(np.maximum(self.lengths, 1)) / np.log(BIN)).astype(np.int64)
        for b in np.unique(self.bin_of[self.edits > 0]):
            members = np.flatnonzero((self.bin_of == b) & (self.edits > 0))
            self.bins.append((members, *self._walks(members, np.random.default_rng([seed, b]))))

    def _walks(self, members: np.ndarray, rng: np.random.Generator) -> tuple[int, list | None]:
        """The steps of the walks for some items, and path, places and the items' keys of each.

        Without walks (None) where MOST_WALKS do not find enough of the edited copies.
        """
        # A walk takes about two steps a word; staying within the shortest item keeps places inside all.
        steps = max(PLACES, int(1.6 * self.lengths[members].min()))
        own = np.concatenate([[0], (self.lengths[members] + steps).cumsum()])
        symbols = np.concatenate([hashes(self.items[i][1], steps) for i in members])
        copies, starts, copy, at = [], [], [], 0
        tried = rng.integers(len(members), size=TRIES)
        for t, m in enumerate(tried.tolist()):
            ids, edits = self.items[members[m]][1], int(self.edits[members[m]])
            # The copy stands among unknown words; as in a document, windows around its start are walked.
            text = np.concatenate([np.zeros(edits, np.int64), edited(ids, edits, rng), np.zeros(steps, np.int64)])
            copies.append(text)
            starts.append(np.arange(at, at + 2 * edits + 1))
            copy.append(np.full(2 * edits + 1, t))
            at += len(text)
        texts, start, copy = hashes(np.concatenate(copies), steps), np.concatenate(starts), np.concatenate(copy)
        missed, tables, enough = np.ones(TRIES, bool), [], None
        for w in range(MOST_WALKS):
            path, place = walk(w, steps), np.sort(rng.choice(steps, PLACES, replace=False))
            keys = sampled(symbols, own[:-1], path, place)
            tables.append((path, place, keys))
            if w + 1 == enough:
                return steps, tables
            if enough:
                continue
            open_ = missed[copy]
            met = copy[open_][sampled(texts, start[open_], path, place) == keys[tried[copy[open_]]]]
            missed[met] = False
            if missed.mean() <= 1 - RECALL:  # half as many more: the copies looked at favour the walks that found them
                enough = w + 1 + (w + 2) // 2
        return steps, None

    def search(self, docs: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, edits): the best match of each item in each of some documents."""
        bounds = np.cumsum([0] + [len(d) for d in docs])
        n = int(bounds[-1])
        if not n or not self.items:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, n)
        held = np.bincount(self.postings[0], minlength=len(self.vocabulary) + 1)
        turns = 1 + int(held[ids].sum()) // VOTES
        out = []
        for turn in range(turns):
            windows = self._met(ids, self._windows(ids, turns, turn))
            for i, starts in windows.items():
                own = np.searchsorted(bounds, starts, "right") - 1
                for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(own)) + 1):
                    doc = int(own[part[0]])
                    best = self._settled(i, ids[bounds[doc] : bounds[doc + 1]], (starts[part] - bounds[doc]).tolist())
                    if best:
                        out.append((doc, i, *best))
        return out

    def _met(self, ids: np.ndarray, windows: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """The windows to be settled: runs of adjacent ones of which a walk meets their item, and those of items without walks."""
        out = dict(windows)
        if not windows:
            return out
        symbols = hashes(ids, max([steps for _, steps, _ in self.bins], default=0))
        for members, steps, tables in self.bins:
            found = [(m, i) for m, i in enumerate(members.tolist()) if i in windows]
            if tables is None or not found:
                continue
            sizes = [len(windows[i]) for _, i in found]
            start = np.concatenate([windows[i] for _, i in found])
            member = np.repeat([m for m, _ in found], sizes)
            run = np.cumsum((np.diff(start, prepend=-2) != 1) | (np.diff(member, prepend=-1) != 0)) - 1
            met = np.zeros(int(run[-1]) + 1, bool)
            left = np.arange(len(start))
            for path, place, keys in tables:
                left = left[~met[run[left]]]
                if not len(left):
                    break
                own, back = np.unique(start[left], return_inverse=True)
                agree = sampled(symbols, own, path, place)[back] == keys[member[left]]
                met[run[left[agree]]] = True
            for (m, i), rows in zip(found, np.split(np.arange(len(start)), np.cumsum(sizes)[:-1]), strict=True):
                kept = start[rows][met[run[rows]]]
                if len(kept):
                    out[i] = kept
                else:
                    del out[i]
        return out

    def _windows(self, ids: np.ndarray, turns: int = 1, turn: int = 0) -> dict[int, np.ndarray]:
        """Starts of the windows that can hold each item of this turn at all: most of its rare words, in place but for the edits.

        A match keeps all of the item's words but the allowed edits, each within as many places of its own.
        Words that are rare in these documents tell most; an item with too few of them goes by all its words.
        What counts as rare changes the cost, not the result.
        """
        word, item, offset = self.postings
        rare = np.bincount(ids, minlength=len(self.vocabulary) + 1) < max(2, RARE * len(ids))
        need = np.bincount(item, rare[word], len(self.items)).astype(np.int64) - self.edits
        by_all = need < LEAST
        need[by_all] = (self.lengths - self.edits)[by_all]
        used = (rare[word] | by_all[item]) & (item % turns == turn)
        word, item, offset = word[used], item[used], offset[used]
        first = np.searchsorted(word, np.arange(len(self.vocabulary) + 2))
        count = np.diff(first)[ids]
        count[ids == 0] = 0
        at = np.flatnonzero(count)
        count = count[at]
        ends = count.cumsum()
        posting = np.repeat(first[ids[at]] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        # Where the item would begin if this word stood in its place.
        key = item[posting] * SPAN + np.repeat(at, count) - offset[posting] + MARGIN
        key.sort()
        of = key // SPAN
        last = np.arange(len(key)) + need[of] - 1
        inside = np.flatnonzero(last < len(key))
        inside = inside[key[last[inside]] - key[inside] <= 2 * self.edits[of[inside]]]
        out = {}
        for i in np.unique(of[inside]):
            rows = inside[of[inside] == i]
            low, high = key[last[rows]] - self.edits[i], key[rows] + self.edits[i]
            n = high - low + 1
            starts = np.repeat(low - (n.cumsum() - n), n) + np.arange(n.sum()) - i * SPAN - MARGIN
            out[int(i)] = np.unique(np.clip(starts, 0, len(ids) - 1))
        return out

    def _settled(self, i: int, ids: np.ndarray, starts: list[int]) -> tuple[int, int, int] | None:
        """First word, words and edits of the best match near the candidate starts, if it is near enough."""
        item, edits = self.items[i][1], int(self.edits[i])
        best, done = None, -1
        for s in starts:
            if s <= done:  # an earlier candidate looked at all places that this one could match
                continue
            low, high = max(0, s - edits), min(len(ids), s + len(item) + 2 * edits + 1)
            done = s + edits
            distance, end = edit_distance(item, ids[low:high])
            if distance <= edits and (best is None or distance < best[2]):
                length = _length(item[::-1], ids[low : low + end][::-1])
                best = (low + end - length, length, distance)
                if not distance:
                    break
        return best


def _length(item: np.ndarray, text: np.ndarray) -> int:
    """Words of the shortest beginning of the text that is nearest to the whole item."""
    row = ramp = np.arange(len(text) + 1)
    for i, symbol in enumerate(item, 1):
        best = np.minimum(row[:-1] + (text != symbol), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], best]) - ramp) + ramp
    return int(row.argmin())


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits, item_words: each item's best match in each document.

    A match is a run of the document's words within `share` of the item's length in word edits, after
    lower-casing and leaving out punctuation. Copies with all the edits that are allowed are found
    at RECALL, those with fewer more surely. Items of fewer than five words match exact runs of words only. Null
    items and null or empty texts match nothing; equal items match each by itself; repeated rows are all
    reported. The documents are read once for each BLOCK_BYTES of benchmark text and never shuffled.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long, item_words long"
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own], share))
        found = narrow.mapInArrow(_searcher(index), schema)
        out = found if out is None else out.union(found)
    return out


def _searcher(index):
    def search(batches):
        held = index.value
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for at in range(0, len(texts), DOCUMENTS):
                found = held.search([normalised(t) for t in texts[at : at + DOCUMENTS]])
                rows += [(ids[at + d], held.items[i][0], *m, len(held.items[i][1])) for d, i, *m in found]
            names = ["doc_id", "item_id", "first_word", "n_words", "edits", "item_words"]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item is found.

    Rows that repeat an id are dropped together, as one of them holds the item.
    """
    found = contaminated(docs, benchmark, share).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found"]), "left_anti")
