"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, exact at the threshold.

Vectors of one label are compared within cells. If a pair is within the threshold, the second vector is so
near to the first that it cannot lie far on its own side of the plane between their two centres: with unit
vectors at distance d, its signed distance to that plane is at most d. So a vector also visits every
lower-numbered cell whose plane is within d, and each pair meets exactly once, in the lower of its two
cells. No pair is lost, and no pair of vectors in different visits is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Centres are fitted on at most so many vectors, chosen by a hash; every vector is assigned and compared.
SAMPLE = 20_000
CELL = 400
MOST_CELLS = 2_048
BLOCK = 512


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centres of unit vectors; an empty cell keeps its last centre."""
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _unit(values: list, dims: int | None = None) -> tuple[np.ndarray, list[bool]]:
    """Unit vectors in double precision and which rows have one; the others are zero."""
    good = [v is not None and len(v) > 0 and all(c is not None for c in v) for v in values]
    width = dims or max((len(v) for v, g in zip(values, good, strict=True) if g), default=1)
    x = np.zeros((len(values), width))
    for i, (v, g) in enumerate(zip(values, good, strict=True)):
        if g and len(v) == width:
            x[i] = v
        else:
            good[i] = False
    with np.errstate(all="ignore"):
        scale = np.abs(x).max(1, initial=0)
        finite = np.isfinite(scale) & (scale > 0)
        x = np.where(finite[:, None], x / np.where(finite, scale, 1)[:, None], 0)  # no overflow in squares
        x /= np.where(finite, np.linalg.norm(x, axis=1), 1)[:, None]
    return x, [bool(g and f) for g, f in zip(good, finite, strict=True)]


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their vector, and one usable vector for each label and key.

    Vectors of different lengths never compare: the length is part of the key and of the group.
    """

    def key(batches):
        for batch in batches:
            values = batch.column("embedding").to_pylist()
            usable, digests, units, lengths = [], [], [], []
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                by_length.setdefault(len(v) if v is not None else 0, []).append(i)
            found: dict[int, np.ndarray] = {}
            for n, rows in by_length.items():
                x, good = _unit([values[i] for i in rows], n or None)
                found.update({i: x[j] for j, i in enumerate(rows) if good[j]})
            for i, v in enumerate(values):
                usable.append(i in found)
                raw = np.array(v, np.float64).tobytes() if i in found else b""
                digests.append(xxhash.xxh3_128_digest(raw) if i in found else None)
                units.append(found[i].tolist() if i in found else None)
                lengths.append(len(v) if i in found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(lengths, pa.int32()), pa.array(units, pa.list_(pa.float64()))],
                ["vec_id", "label", "vec_key", "dims", "unit"],
            )

    narrow = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "embedding")
    rows = written(narrow.mapInArrow(key, "vec_id long, label long, vec_key binary, dims int, unit array<double>"))
    usable = rows.where("vec_key IS NOT NULL AND label IS NOT NULL")
    distinct = usable.groupBy("label", "dims", "vec_key").agg(F.count("*").alias("copies"), F.first("unit").alias("unit"))
    return rows.select("vec_id", "label", "dims", "vec_key"), written(distinct.withColumn("node", F.monotonically_increasing_id()))


def _centres(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres for each vector length; cells follow the size of the table up to a bound."""
    fitted = {}
    for dims in [r["dims"] for r in classes.select("dims").distinct().collect()]:
        chosen = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_key"), "node").limit(SAMPLE)
        x = np.array(chosen.select("unit").toPandas()["unit"].tolist())
        fitted[dims] = spherical_kmeans(x, max(1, min(MOST_CELLS, n // CELL, len(x) // 8 or 1)))
    return fitted


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows of one label (not null) with cosine >= threshold in double precision are linked; equal vectors are
    one class and never expanded into pairs. Null, zero, or non-finite vectors and null labels link with
    nothing. Rows that repeat a vec_id are rows of their own. Other columns are not read.
    """
    rows, classes = _classes(vectors)
    n = classes.count()
    centres = _centres(classes, n)
    distance = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def assign(batches):
        for batch in batches:
            units, dims = batch.column("unit").to_pylist(), batch.column("dims").to_pylist()
            cells = []
            for v, d in zip(units, dims, strict=True):
                c = centres[d]
                near = c @ np.array(v)
                home = int(near.argmax())
                gap = np.linalg.norm(c[:home] - c[home], axis=1)
                # The signed distance of the vector to the plane between its own centre and each lower one.
                visits = np.flatnonzero(near[home] - near[:home] <= distance * gap)
                cells.append([(home, True), *((int(j), False) for j in visits)])
            flat = [x for c in cells for x in c]
            at = np.repeat(np.arange(batch.num_rows), [len(c) for c in cells])
            held = pa.Table.from_batches([batch]).take(pa.array(at)).combine_chunks().to_batches()[0] if len(flat) else batch
            yield pa.RecordBatch.from_arrays(
                [*(held.column(c) for c in ("node", "label", "dims", "copies", "unit")), pa.array([c for c, _ in flat], pa.int32()), pa.array([h for _, h in flat], pa.bool_())],
                ["node", "label", "dims", "copies", "unit", "cell", "home"],
            )

    schema = "node long, label long, dims int, copies long, unit array<double>, cell int, home boolean"
    placed = written(classes.select("node", "label", "dims", "copies", "unit").mapInArrow(assign, schema))
    cell = ["label", "dims", "cell"]
    counts = placed.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count("*").alias("all"))
    blocks = counts.where("homes > 0 AND all > 1").select(*cell, F.ceil(F.col("homes") / BLOCK).alias("nh"), F.ceil((F.col("all") - F.col("homes")) / BLOCK).alias("nv"))
    joined = placed.join(blocks, cell)
    block = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("nh"))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("nv", F.lit(1))))
    spread = joined.withColumn("block", block)
    # Left blocks are residents i; right blocks are residents j >= i, or visitors (numbered on from nh).
    at_home = F.concat(
        F.transform(F.sequence(F.col("block"), F.col("nh") + F.col("nv") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("left"))),
        F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("block") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"))))
        .otherwise(F.array().cast("array<struct<i:bigint,j:bigint,left:boolean>>")),
    )
    visiting = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1), lambda i: F.struct(i.alias("i"), (F.col("nh") + F.col("block")).alias("j"), F.lit(False).alias("left")))
    tasks = spread.withColumn("t", F.explode(F.when(F.col("home"), at_home).otherwise(visiting)))
    tasks = tasks.select(*cell, F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.left").alias("left"), "node", "copies", "unit")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        a, same = frame[frame["left"]], frame["i"].iat[0] == frame["j"].iat[0]
        b = a if same else frame[~frame["left"]]
        empty = pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        if not len(a) or not len(b):
            return empty
        x, y = np.stack(a["unit"].to_numpy()), np.stack(b["unit"].to_numpy())
        linked = x @ y.T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        na, nb = a["node"].to_numpy(), b["node"].to_numpy()
        ra, rb = linked.any(1), linked.any(0)
        linked, na, nb = linked[np.ix_(ra, rb)], na[ra], nb[rb]
        if not len(na):
            return empty
        links_a, links_b = linked @ b["copies"].to_numpy()[rb], linked.T @ a["copies"].to_numpy()[ra]
        la, lb = na.copy(), nb.copy()
        while True:  # the smallest node of each component inside these two blocks
            more = np.minimum(la, np.where(linked, lb[None, :], np.iinfo(np.int64).max).min(1))
            other = np.minimum(lb, np.where(linked, more[:, None], np.iinfo(np.int64).max).min(0))
            if same:
                more = other = np.minimum(more, other)
            if (more == la).all() and (other == lb).all():
                break
            la, lb = more, other
        out = pd.DataFrame({"node": na, "links": links_a, "to": la})
        return out if same else pd.concat([out, pd.DataFrame({"node": nb, "links": links_b, "to": lb})])

    found = written(tasks.groupBy(*cell, "i", "j").applyInPandas(compare, "node long, links long, to long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    named = rows.join(classes.select("label", "dims", "vec_key", "node", "copies"), ["label", "dims", "vec_key"], "left")
    named = named.join(linked, "node", "left").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    named = written(named.select("vec_id", "c", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links")))
    least = named.where("c IS NOT NULL").groupBy("c").agg(F.min("vec_id").alias("least"))
    component = F.coalesce("least", "vec_id")
    return named.join(least, "c", "left").select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
