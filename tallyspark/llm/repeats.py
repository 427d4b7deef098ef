"""Removal of repeated byte strings: every byte covered by a string of `length` bytes that also starts elsewhere.

Anchors. Each window of `length` bytes chooses the least-hashed of its substrings of `GRAM` bytes, the leftmost of
equals. The choice depends on the window's bytes alone, so equal windows choose equal substrings at equal offsets,
and neighbouring windows mostly share theirs: an anchor, its run of windows and the bytes they cover (a context)
are one narrow row for some 70 windows. Anchors whose substring occurs once have no repeated window and go first.
Contexts that occur twice, by their 128-bit names, are repeated whole. What is left is to compare different
contexts around equal substrings, a bucket.

Suffix order. The contexts of a bucket are sorted as suffixes that begin at the anchor, and once more backwards as
reversed prefixes that end there. Suffixes are compared by their longest common extension, found by binary search
over prefix polynomial hashes, in a bottom-up mergesort that ranks each element in its sibling run by binary
search. Neighbours' extensions are then checked byte by byte, which proves the order too; a hash collision makes
the sort begin again with another hash. Windows at offset o before their anchors are equal exactly if their
contexts share `length - o` bytes forward and o bytes backward: both are intervals of the two orders.

A bucket of more than `BUCKET` different contexts is not gathered: 128-bit names of what blocks of windows cover, and of what
all windows of a block have in common, are counted with partial sums before the shuffle. Single windows are named and
counted only in blocks that differ but have that in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, written

LENGTH = 200
GRAM = 48
BUCKET = 2048
# Bytes hashed at once; positions within them take PLACE bits of the packed minima.
SEGMENT, PLACE = 4 << 20, 23
# Contexts sorted at once, in whole buckets.
CONTEXTS = 20_000

ANCHORS = "doc_id long, a long, b long, g long, u long, s long, o int, w int"
_M = (1 << 64) - 1


class Hasher:
    """Prefix polynomial hashes modulo 2^64 with a random value for each byte; any substring's hash takes two look-ups."""

    def __init__(self, seed: int) -> None:
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        self.base = int(mix(np.array([seed + 1000], np.uint64))[0]) | 1
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        def row(base):
            out = np.ones(n, np.uint64)
            done, step = 1, base
            while done < n:  # the second half is the first one times base^done
                out[done : 2 * done] = (out[: min(done, n - done)] * np.uint64(step)).astype(np.uint64)
                step, done = step * step & _M, 2 * done
            return out

        self.n, self.up, self.down = n, row(self.base), row(pow(self.base, -1, 1 << 64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= self.n:
            self._powers(1 << (len(data) + 1).bit_length())
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` values, by doubling."""
    n, have, least = len(values) - width + 1, 1, values
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[:n], least[rest : rest + n])


_HASHERS: dict[int, Hasher] = {}


def _hasher(seed: int) -> Hasher:
    if seed not in _HASHERS:
        _HASHERS[seed] = Hasher(seed)
    return _HASHERS[seed]


def anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """Anchors of the windows that start at the `valid` places (ascending): arrays g, u, first window, offset, windows.

    All windows lie within `data`. A run of windows ends where the next valid place doesn't follow or has another anchor.
    """
    one, two = _hasher(1), _hasher(2)
    sums, other = one.prefix(data), two.prefix(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * one.down[:n])
    packed = ((grams >> np.uint64(PLACE)) << np.uint64(PLACE)) | np.arange(n, dtype=np.uint64)
    at = (_least(packed, length - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)[valid]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    count = np.diff(np.r_[first, len(at)])
    s, anchor = valid[first], at[first]
    offset = anchor - s
    whole = mix(two.of(other, s, s + count - 1 + length) + (offset * 1024 + count).astype(np.uint64))
    return grams[anchor].view(np.int64), whole.view(np.int64), s, offset, count


def _find_anchors(length: int, gram: int):
    names = ["doc_id", "a", "b", "g", "u", "s", "o", "w"]

    def segments(texts: pa.Array):
        """(data, first byte of each document in it, its row, its offset in the document, its bytes) for SEGMENT bytes at most."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        parts, held = [], 0
        for row in range(len(texts)):
            start, end = int(offsets[row]), int(offsets[row + 1])
            for low in range(start, max(start + 1, end - length + 1), SEGMENT // 2):
                high = min(end, low + SEGMENT // 2 + length - 1)
                if high - low < length:
                    continue
                if held + high - low > SEGMENT:
                    yield data, parts
                    parts, held = [], 0
                parts.append((row, low - start, low, high))
                held += high - low
        if parts:
            yield data, parts

    def find(batches):
        for batch in batches:
            for data, parts in segments(batch.column("text").cast(pa.string())):
                rows, shifts, lows, highs = (np.array(x, np.int64) for x in zip(*parts, strict=True))
                sizes = highs - lows
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                joined = np.concatenate([data[a:b] for a, b in zip(lows, highs, strict=True)])
                windows = sizes - length + 1
                part = np.repeat(np.arange(len(parts)), windows)
                valid = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - starts, windows)
                g, u, s, o, w = anchors(joined, valid, length, gram)
                of = part[np.searchsorted(valid, s)]
                take = pa.array(rows[of])
                columns = [batch.column(c).take(take) for c in ("doc_id", "a", "b")]
                columns += [pa.array(x) for x in (g, u, s - starts[of] + shifts[of], o.astype(np.int32), w.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return find


# ---- suffix order within buckets


class Suffixes:
    """Suffixes of one byte array, each cut at its `end`, compared by hashed common extensions."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, bucket: np.ndarray, cap: int) -> None:
        self.data, self.start, self.size = data, start, np.minimum(end - start, cap)
        self.bucket, self.cap = bucket, cap
        for seed in range(3, 40):
            self.hasher = _hasher(seed)
            self.sums = self.hasher.prefix(data)
            self.sort()
            if self.proven():
                return
        raise RuntimeError("no hash without collisions found")

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefix of suffixes x and y, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        p, q = self.start[x], self.start[y]
        for _ in range(int(self.cap).bit_length()):
            middle = (low + high + 1) // 2
            same = self.hasher.of(self.sums, p, p + middle) == self.hasher.of(self.sums, q, q + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def sign(self, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x is before, equal to or after y, given their common prefix; an end is before any byte."""
        last = len(self.data) - 1
        of = np.where(shared < self.size[x], self.data[np.minimum(self.start[x] + shared, last)].astype(np.int64), -1)
        to = np.where(shared < self.size[y], self.data[np.minimum(self.start[y] + shared, last)].astype(np.int64), -1)
        return np.sign(of - to)

    def sort(self) -> None:
        """Order within buckets: runs of 1, 2, 4, ... are merged, all pairs of runs of all buckets at once."""
        order = np.argsort(self.bucket, kind="stable")
        held = self.bucket[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        sizes = np.diff(np.r_[first, len(held)])
        base, many = np.repeat(first, sizes), np.repeat(sizes, sizes)
        local = np.arange(len(order)) - base
        width = 1
        while width < sizes.max():
            act = np.flatnonzero(many > width)
            run = local[act] // width
            odd = run % 2 == 1
            low = np.minimum(np.where(odd, run - 1, run + 1) * width, many[act])
            high = np.minimum(low + width, many[act])
            begin = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                x, y = order[act[open_]], order[base[act[open_]] + middle]
                sign = self.sign(y, x, self.extension(x, y))
                before = np.where(odd[open_], sign <= 0, sign < 0)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = (run // 2) * 2 * width + local[act] - run * width + low - begin
            moved = order.copy()
            moved[base[act] + place] = order[act]
            order, width = moved, 2 * width
        self.order = order
        self.new = np.r_[True, held[1:] != held[:-1]]
        inside = np.flatnonzero(~self.new)
        self.shared = np.zeros(len(order), np.int64)
        self.shared[inside] = self.extension(order[inside - 1], order[inside])

    def proven(self) -> bool:
        """Whether neighbours share the bytes they are said to and stand in order; then all suffixes do."""
        inside = np.flatnonzero(~self.new)
        x, y, shared = self.order[inside - 1], self.order[inside], self.shared[inside]
        step = np.arange(shared.sum()) - np.repeat(np.cumsum(shared) - shared, shared)
        equal = self.data[np.repeat(self.start[x], shared) + step] == self.data[np.repeat(self.start[y], shared) + step]
        return bool(equal.all()) and bool((self.sign(x, y, shared) <= 0).all())

    def classes(self, depth: int) -> np.ndarray:
        """Number of the interval of suffixes that share `depth` bytes, for each suffix."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new | (self.shared < depth))
        return out


def repeated_windows(contexts: list[bytes], bucket: np.ndarray, offset: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the contexts are those of another context in their bucket: contexts x most windows, boolean.

    A context holds `windows` windows of `length` bytes from its first byte on, and its anchor at `offset`.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    anchor = start + offset
    onward = Suffixes(data, anchor, end, bucket, length)
    total = len(data)
    back = Suffixes(data[::-1], total - anchor, total - start, bucket, length)
    found = np.zeros((len(contexts), int(windows.max())), bool)
    for o in range(int(offset.max()) + 1):
        held = np.flatnonzero((o <= offset) & (o > offset - windows))
        if len(held) < 2:
            continue
        keys = onward.classes(length - o)[held] * (len(contexts) + 1) + back.classes(o)[held]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        twice = held[order[np.r_[same, False] | np.r_[False, same]]]
        found[twice, offset[twice] - o] = True
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    steps = np.diff(padded, axis=1)
    row, low = np.nonzero(steps == 1)
    return row, low, np.nonzero(steps == -1)[1] - 1


RANGES = "g long, u long, low int, high int"


def _compare_buckets(length: int):
    def compare(rows):
        g, u, o, w = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        contexts = [r[4] for r in rows]
        row, low, high = _runs(repeated_windows(contexts, np.unique(g, return_inverse=True)[1], o, w, length))
        columns = [pa.array(g[row]), pa.array(u[row]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["g", "u", "low", "high"])

    def search(batches):
        rows: list[tuple] = []
        seen: set[int] = set()
        bucket = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "u", "o", "w", "context")), strict=True):
                if row[0] != bucket:
                    bucket = row[0]
                    seen.clear()
                    if len(rows) >= CONTEXTS:
                        yield compare(rows)
                        rows = []
                if row[1] not in seen:
                    seen.add(row[1])
                    rows.append(row)
        if rows:
            yield compare(rows)

    return search


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> list[np.ndarray]:
    """128-bit names of byte strings, as two columns; `mark` is part of the name."""
    return [mix(h.of(h.prefix(data), start, start + size) + mark.astype(np.uint64)).view(np.int64) for h in (_hasher(1), _hasher(2))]


def _parts(batches, *columns):
    """Some contexts at a time: the rows, their bytes in one array, where their anchors are in it, and the asked columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            data = np.frombuffer(b"".join(part.column("context").to_pylist()), np.uint8)
            yield part, data, *(part.column(c).to_numpy().astype(np.int64) for c in columns)


def _name_blocks(length: int, step: int):
    """Blocks of `step` offsets in which a context has windows: g, u, low, x, y, p, q, first, last.

    (x, y) names the bytes that all windows of the block share, (p, q) those that the context's own windows in it cover
    together; these are its windows `first` to `last`.
    """
    names = ["g", "u", "low", "x", "y", "p", "q", "first", "last"]

    def name(batches):
        for part, data, w, offset in _parts(batches, "w", "o"):
            sizes = w + length - 1
            anchor = np.cumsum(sizes) - sizes + offset
            first, last = (offset - w + 1) // step, offset // step
            many = last - first + 1
            row = np.repeat(np.arange(len(w)), many)
            low = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            left = low * step
            # Equal windows of a bucket stand at the same offset from their anchor, which is part of the names.
            core = _hashed(data, anchor[row] - left, np.full(len(row), length - step + 1), left)
            near, far = np.maximum(left, offset[row] - w[row] + 1), np.minimum(left + step - 1, offset[row])
            whole = _hashed(data, anchor[row] - far, far - near + length, far * 1024 + near)
            take, narrow = pa.array(row), [low, offset[row] - far, offset[row] - near]
            low, begin, end = (pa.array(x.astype(np.int32)) for x in narrow)
            columns = [part.column("g").take(take), part.column("u").take(take), low, *map(pa.array, (*core, *whole)), begin, end]
            yield pa.RecordBatch.from_arrays(columns, names)

    return name


def _name_windows(length: int):
    """Windows of the listed ranges: g, u, window, x, y, where (x, y) is a 128-bit name."""
    names = ["g", "u", "low", "x", "y"]

    def name(batches):
        for part, data, w, offset in _parts(batches, "w", "o"):
            sizes = w + length - 1
            listed = part.column("blocks")
            blocks = np.repeat(np.arange(len(w)), np.diff(listed.offsets.to_numpy()))
            first, last = (listed.flatten().field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            many = last - first + 1
            row = np.repeat(blocks, many)
            low = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            start = (np.cumsum(sizes) - sizes)[row] + low
            xy = _hashed(data, start, np.full(len(row), length), offset[row] - low)
            take = pa.array(row)
            columns = [part.column("g").take(take), part.column("u").take(take), pa.array(low.astype(np.int32)), *map(pa.array, xy)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return name


def _counted(large: DataFrame, length: int) -> DataFrame:
    """Repeated windows of buckets of any size, by counted names.

    A block whose covered bytes occur twice is repeated whole. Windows by themselves are named only where blocks share what
    their windows have in common but not all they cover, and of equal blocks only one then stands for the others.
    """
    step = max(1, int((length / 2) ** 0.5))
    blocks = written(large.mapInArrow(_name_blocks(length, step), "g long, u long, low int, x long, y long, p long, q long, first int, last int"))
    # Narrow tables of counts are written by themselves, so that a very common name's rows can be split in the joins.
    kinds = written(blocks.groupBy("g", "x", "y", "p", "q").agg(F.count("*").alias("n"), F.min(F.struct("u", "first", "last")).alias("one")))
    settled = blocks.join(kinds.where("n > 1").select("g", "p", "q"), ["g", "p", "q"]).select("g", "u", "first", "last")
    partly = written(kinds.groupBy("g", "x", "y").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"))
    asked = kinds.join(partly, ["g", "x", "y"]).groupBy("g", F.col("one.u").alias("u"))
    asked = asked.agg(F.collect_list(F.struct("one.first", "one.last")).alias("blocks"))
    windows = large.join(asked, ["g", "u"]).select("g", "u", "o", "w", "context", "blocks")
    named = written(windows.mapInArrow(_name_windows(length), "g long, u long, low int, x long, y long"))
    common = written(named.groupBy("g", "x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    single = named.join(common, ["g", "x", "y"]).select("g", "u", F.col("low").alias("first"), F.col("low").alias("last"))
    # A context has at most length - GRAM + 1 windows; ranges that follow one another or overlap are one.
    order = Window.partitionBy("g", "u").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int")
    ranges = settled.union(single).withColumn("begins", begins)
    runs = ranges.select("g", "u", "first", "last", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return runs.groupBy("g", "u", "run").agg(F.min("first").alias("low"), F.max("last").alias("high")).drop("run")


def _fetch(length: int):
    names = ["g", "u", "o", "w", "different", "context"]

    def fetch(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for row, asked in enumerate(batch.column("asked").to_pylist()):
                data = texts[row].as_py()
                rows = [(x["g"], x["u"], x["o"], x["w"], x["different"], data[x["s"] : x["s"] + x["w"] - 1 + length]) for x in asked]
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return fetch


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """a, b, ranges: for each text (by its 128-bit name) with repeated windows, where they start: array of (low, high)."""
    named = _named(docs)
    every = written(named.where(F.octet_length("text") >= length).mapInArrow(_find_anchors(length, gram), ANCHORS))
    # Narrow tables of counts are written by themselves, so that a very common substring's rows can be split in the joins.
    twice = written(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    held = written(every.join(twice, "g"))
    contexts = written(held.groupBy("g", "u", "o", "w").agg(F.count("*").alias("n"), F.min(F.struct("a", "doc_id", "s")).alias("at")))
    mixed = written(contexts.groupBy("g").agg(F.count("*").alias("different")).where("different > 1"))
    asked = contexts.join(mixed, "g")
    places = asked.groupBy(F.col("at.a").alias("a"), F.col("at.doc_id").alias("of")).agg(
        F.collect_list(F.struct("g", "u", "o", "w", F.col("at.s").alias("s"), "different")).alias("asked")
    )
    # Texts are shuffled; a plan that broadcasts the places of a small corpus would not hold for a large one.
    t, p = named.alias("t"), places.hint("merge").alias("p")
    found = t.join(p, (F.col("t.a") == F.col("p.a")) & F.col("t.doc_id").eqNullSafe(F.col("p.of"))).select("text", "asked")
    strings = written(found.mapInArrow(_fetch(length), "g long, u long, o int, w int, different long, context binary"))
    small = strings.where(F.col("different") <= bucket).drop("different").repartition("g").sortWithinPartitions("g")
    compared = small.mapInArrow(_compare_buckets(length), RANGES)
    large = written(strings.where(F.col("different") > bucket).drop("different").dropDuplicates(["g", "u"]))
    counted = _counted(large, length)
    whole = contexts.where("n > 1").select("g", "u", F.lit(0).alias("low"), (F.col("w") - 1).alias("high"))
    # Windows of contexts that occur twice are repeated anyway.
    ranges = written(compared.union(counted).join(whole.select("g", "u"), ["g", "u"], "left_anti").union(whole))
    placed = held.join(ranges, ["g", "u"]).select("a", "b", (F.col("s") + F.col("low")).alias("low"), (F.col("s") + F.col("high")).alias("high"))
    return placed.distinct().groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))


CUT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def _cut(length: int):
    like = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
    ])

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            rows = []
            for row, ranges in enumerate(batch.column("ranges").to_pylist()):
                data = texts[row].as_py()
                spans, kept, at = [], [], 0
                for x in ranges or ():
                    start, end = x["low"], x["high"] + length
                    if spans and start <= spans[-1]["end"]:
                        spans[-1]["end"] = max(end, spans[-1]["end"])
                    else:
                        spans.append({"start": start, "end": end})
                for span in spans:
                    kept.append(data[at : span["start"]])
                    at = span["end"]
                rows.append((ids[row], len(data), spans, b"".join([*kept, data[at:]])))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like, strict=True)], schema=like)

    return cut


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, removed, kept for every row of `docs` (doc_id, text): removed spans of bytes, and the bytes left.

    A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in the same text or in
    another; all strings are judged on the whole input. Spans are maximal: [start, end), ascending, neither touching nor
    overlapping. A cut can fall within a character, so `kept` is binary. A null text is empty, texts shorter than `length`
    stay whole, rows that repeat an id or a text are documents of their own (equal texts of `length` bytes or more lose
    all). Other columns are not read; an empty table gives an empty one.
    """
    ranges = repeated_ranges(docs, length, gram, bucket).hint("merge").alias("r")
    t = _named(docs).alias("t")
    joined = t.join(ranges, (F.col("t.a") == F.col("r.a")) & (F.col("t.b") == F.col("r.b")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_cut(length), CUT)
