"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. Each document's five-word shingles give `BANDS * ROWS` minima. A band of full minima is a bucket key;
   of each minimum only the low bits are kept, packed into three integers.
2. Documents with equal sets are one class from here on; copies are never expanded into pairs.
3. Each bucket links its members to a hub, its most central member. Bit counts of the packed signatures,
   corrected for chance agreement of low bits, drop pairs far below the threshold; the others are compared
   on whole sets.
4. Buckets that are not one component then get a few more hubs. Members still apart from their bucket's first
   hub are compared with all members that lie in another component, so that no link is left open.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, mix, words, written
from .components import components

SHINGLE = 5
ROWS = 3
BANDS = 24
BITS = 2
MINIMA = ROWS * BANDS
# With 72 two-bit minima the estimate's standard error near 0.75 is 0.061; four of them are allowed for.
SLACK = 0.25
SETS = 1 << 15
HUBS = 3


def _word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def shingle_sets(texts: list[bytes | None], memo: Memo) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word runs; fewer than five words count as one run."""
    out = []
    for text in texts:
        found = words(text)
        n = len(found)
        hashes = np.fromiter(map(memo.__getitem__, found), np.uint64, n)
        width = min(SHINGLE, n)
        if not n:
            out.append(hashes)
            continue
        # A run is hashed over its words in order; the width keeps short texts apart from runs.
        held = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            held = mix(held ^ hashes[i : n - width + 1 + i])
        out.append(np.unique(held))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash minima of non-empty sets, one row per set."""
    seeds = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint64)
    for k, seed in enumerate(seeds):
        # An odd multiplier permutes 64-bit integers; the high half is the better mixed one.
        out[:, k] = np.minimum.reduceat((flat ^ seeds[k - 1]) * seed, starts)
    return out


def _packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima of each row in three 64-bit integers."""
    lanes = np.zeros((len(low), 3), np.uint64)
    for k in range(MINIMA):
        lanes[:, k // 32] |= low[:, k] << np.uint64(BITS * (k % 32))
    return lanes.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, bands, s0, s1, s2; a text without words has no bands and no hash."""

    def sign(batches):
        memo = _word_hashes()
        for batch in batches:
            ids, marks, texts = batch.column("doc_id"), batch.column("text_hash"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 8 * SETS):  # about SETS words at six bytes each
                    size += len(texts[stop] or b"")
                    stop += 1
                yield _signed(ids[at:stop], marks[at:stop], shingle_sets(texts[at:stop], memo))
                at = stop

    schema = "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>, s0 long, s1 long, s2 long"
    text = F.col("text").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), text).mapInArrow(sign, schema)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _signed(ids: pa.Array, marks: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    full = [s for s in sets if len(s)]
    hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    bands, sig = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), 3), np.int64)
    if full:
        has = np.array([len(s) > 0 for s in sets])
        lows = minima(full)
        keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
        for r in range(ROWS):
            keys = mix(keys ^ lows[:, r::ROWS])
        bands[has] = keys.view(np.int64)
        # Minima are scrambled first: the low bits of a smallest product are not evenly spread.
        sig[has] = _packed(mix(lows) & np.uint64((1 << BITS) - 1))
    offsets = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)
    kept = bands[[len(s) > 0 for s in sets]].reshape(-1) if full else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            marks,
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(hashes, pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept)),
            *(pa.array(sig[:, i].copy()) for i in range(3)),
        ],
        ["doc_id", "text_hash", "n_shingles", "set_hash", "bands", "s0", "s1", "s2"],
    )


def estimated(a: str, b: str) -> Column:
    """Similarity from agreeing low bits, less the agreement that chance alone gives."""
    same = F.lit(0)
    for i in range(3):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        same = same + F.bit_count(pairs)
    chance = 1 / (1 << BITS)
    return (1 - same / MINIMA - chance) / (1 - chance)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the wanted classes, computed again from one text of each class."""

    def sets(batches):
        memo = _word_hashes()
        for batch in batches:
            nodes, texts = batch.column("node"), batch.column("text").to_pylist()
            for at in range(0, len(texts), 64):
                found = [s.view(np.int64) for s in shingle_sets(texts[at : at + 64], memo)]
                yield pa.RecordBatch.from_arrays(
                    [nodes[at : at + 64], pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                    ["node", "found", "shingles"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    chosen = texts.join(wanted.select("node", "rep").hint("merge"), texts["rep"].eqNullSafe(wanted["rep"])).select("node", "text")
    # Rows that repeat an id with another text, or the same text, are told apart by the set itself.
    made = chosen.mapInArrow(sets, "node long, found binary, shingles array<long>")
    own = wanted.select(F.col("node").alias("own"), "set_hash")
    return made.join(own, (made["node"] == own["own"]) & (made["found"] == own["set_hash"])).select("node", "shingles").dropDuplicates(["node"])


def _near(a: str, b: str, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(a, "u").join(b, "v").where(_near("a", "b", percent)).select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, text_hash.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. component_id
    is the smallest doc_id reachable by links, its own included. A text that is null or has no words is
    linked with nothing. Rows that repeat an id are rows of their own; null ids sort after all others and
    stay null where nothing smaller is reachable. Columns other than doc_id and text are not read.
    """
    signed = written(signatures(docs))
    classes = written(
        signed.where("set_hash IS NOT NULL")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("bands", "s0", "s1", "s2")))
        .withColumn("node", F.monotonically_increasing_id())
    )
    links = _links(docs, classes, percent)
    joined = components(links)
    named = classes.join(joined, "node", "left").select("set_hash", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "component").select("set_hash", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_hash").join(final, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash"
    )


def _centred(buckets: DataFrame) -> DataFrame:
    """Members of buckets of two or more, with a one-element array of the bucket's hub.

    The hub is the member whose buckets are the fullest: in a group of altered copies that is the text nearest
    to what they share, so that one hub links most of a large group.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    weighed = buckets.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"), F.collect_list("key").alias("keys"))
    rows = written(weighed.select("node", "weight", F.explode("keys").alias("key")))  # at most BANDS keys a node
    hubs = rows.groupBy("key").agg(F.array(F.max(F.struct("weight", "node"))["node"]).alias("hubs"))
    return rows.select("node", "key").join(hubs, "key")


def _others(members: DataFrame) -> DataFrame:
    """key and HUBS more hubs of each bucket of several components: the smallest members after flipping some bits."""
    flips = [F.lit(int(mix(np.array([HUBS + j], np.uint64))[0] >> np.uint64(1))) for j in range(HUBS)]
    hubs = [F.min(F.col("node").bitwiseXOR(f)).alias(f"h{j}") for j, f in enumerate(flips)]
    found = members.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *hubs).where("c0 < c1")
    return found.select("key", F.array(*[F.col(f"h{j}").bitwiseXOR(f) for j, f in enumerate(flips)]).alias("hubs"))


def _pairs(members: DataFrame) -> DataFrame:
    """Distinct unordered pairs of a node and a hub of one of its buckets."""
    spread = members.select("node", F.explode("hubs").alias("hub")).where("node <> hub")
    return spread.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    floor = percent / 100 - SLACK
    sig = classes.select("node", "s0", "s1", "s2")
    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = written(_centred(buckets))
    likely = written(_likely(_pairs(shared), sig, floor))
    # Every class that shares a bucket may be compared later; its set is written once.
    reps = classes.select("node", "rep", "set_hash").join(shared.select("node").distinct(), "node", "left_semi")
    sets = written(_sets(docs, reps))
    links = written(_confirmed(likely, sets, percent))
    # A few more hubs where a bucket is not one component yet: rows stay in proportion to its members.
    at = written(_labelled(shared, links))
    more = _pairs(at.select("key", "node").join(_others(at), "key")).join(likely, ["u", "v"], "left_anti")
    further = written(_likely(more, sig, floor))
    links = written(links.union(_confirmed(further, sets, percent)))
    # What is still apart: members outside the first hub's component against all of other components.
    at = _labelled(shared, links)
    main = at.where(F.col("node") == F.col("hubs")[0]).select("key", F.col("c").alias("h"))
    at = written(at.join(main, "key").select("key", "node", "c", "h"))
    open_ = at.where("c <> h").select("key").distinct()
    at = written(at.join(open_, "key", "left_semi").join(classes.select("node", "bands", "s0", "s1", "s2"), "node").join(sets, "node"))
    # Both outside: the smaller one asks. One outside: it asks. Sets are compared where the rows meet, so that a
    # large group of texts that are alike, yet not alike enough, gives no rows.
    apart = F.expr("a.key = b.key AND a.c <> b.c AND (b.c = b.h OR a.node < b.node)")
    once = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.key")  # in one of their common buckets
    near = (estimated("a", "b") >= floor) & once & _near("a.shingles", "b.shingles", percent)
    pairs = at.where("c <> h").alias("a").join(at.alias("b"), apart & near)
    return links.union(written(pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()))


def _labelled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket members with the component `c` that the links so far give them."""
    return shared.join(components(links), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _likely(pairs: DataFrame, sig: DataFrame, floor: float) -> DataFrame:
    a = sig.select(F.col("node").alias("u"), F.struct("s0", "s1", "s2").alias("a"))
    b = sig.select(F.col("node").alias("v"), F.struct("s0", "s1", "s2").alias("b"))
    return pairs.join(a, "u").join(b, "v").where(estimated("a", "b") >= floor).select("u", "v")


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of `docs`, all columns, that are the kept document of their component.

    Of rows that repeat a kept id and its text one stays; rows that repeat an id with another text are
    judged by their own text.
    """
    found = written(near_duplicates(docs, percent))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["__gone"]) & (_text_hash() == gone["__hash"])
    kept = docs.join(gone.hint("merge"), same, "left_anti")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
