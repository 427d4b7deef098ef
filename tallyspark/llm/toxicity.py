"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class has its own discounted counts at the highest order (a letter after the five before it, or
after the whole beginning of the word). Both classes share the lower orders, which count in how many
different ways a gram is continued to the left. Where a class has not seen a letter after its context,
the shared estimate is scaled by the weight the class leaves to it, so it cancels in the comparison and
only evidence that one of the classes really has moves the score. The models see words one at a time:
a word's log-likelihood difference is computed once and remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns, mix, written

ORDER = 6
DISCOUNT = 0.75
#: At most so many labelled documents of each class are learned from, chosen by a hash of their id.
SAMPLE = 20_000
#: Of those, one in five fits the final curve and stays out of the counts.
CURVE = 5
#: Log-likelihood differences of a word: from which it counts, from which it is strong, and the most that counts.
EASY, STRONG, MOST = 1.5, 3.0, 6.0
#: Words of no evidence added to a text, so that a few words alone decide little.
SHRINK = 20
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"


def expressions(text: str | None) -> list[str]:
    """Lower-cased runs of letters: marks and digits glued to a word say nothing about it."""
    return LETTERS.findall((text or "").lower())


def _grams(word: str) -> list[str]:
    """The highest-order gram that ends at each letter."""
    s = START + word + END
    return [s[max(0, j - ORDER + 1) : j + 1] for j in range(1, len(s))]


def sample(labels: DataFrame, docs: DataFrame, folds: int) -> DataFrame:
    """doc_id, text, toxic, curve of a bounded sample of labelled documents outside the held-out fold."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learns("doc_id", folds))
    usable = usable.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    chosen = [usable.where(F.col("__toxic") == t).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE) for t in (0, 1)]
    ids = written(chosen[0].union(chosen[1]))
    # Two narrow columns and at most 2 * SAMPLE rows: under a megabyte.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CURVE)) == 0
    return written(rows.select("doc_id", "text", F.col("__toxic").alias("toxic"), curve.alias("curve")))


def gram_counts(chosen: DataFrame) -> DataFrame:
    """gram, n0, n1: how often each gram of every order occurs in ordinary and toxic documents."""

    def count_words(batches):
        for batch in batches:
            counts = [Counter(), Counter()]
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[toxic].update(set(expressions(text)))  # once a document: repetition is no evidence
            every = list(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)], ["word", "n0", "n1"]
            )

    def split(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for word, a, b in zip(*(batch.column(c).to_pylist() for c in ("word", "n0", "n1")), strict=True):
                for top in _grams(word):
                    for k in range(len(top)):
                        n = found.setdefault(top[k:], [0, 0])
                        n[0] += a
                        n[1] += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), *(pa.array([n[i] for n in found.values()], pa.int64()) for i in (0, 1))], ["gram", "n0", "n1"]
            )

    words = chosen.where("NOT curve").select("toxic", "text").mapInArrow(count_words, "word string, n0 long, n1 long")
    words = words.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = words.mapInArrow(split, "gram string, n0 long, n1 long")
    return grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def hashed(grams: DataFrame) -> DataFrame:
    """Counted grams as numbers: keys of the gram, of its context and of its tail, its length, whether it is of the highest order."""

    def run(batches):
        for batch in batches:
            texts = batch.column("gram").to_pylist()
            keys = [pa.array(gram_keys(part)) for part in (texts, [t[:-1] for t in texts], [t[1:] for t in texts])]
            size = np.fromiter(map(len, texts), np.int8, len(texts))
            top = (size == ORDER) | (np.fromiter((t.startswith(START) for t in texts), bool, len(texts)) & (size > 1))
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(size), pa.array(top), batch.column("n0"), batch.column("n1")], ["gram", "context", "tail", "size", "top", "n0", "n1"]
            )

    return grams.select("gram", "n0", "n1").mapInArrow(run, "gram long, context long, tail long, size byte, top boolean, n0 long, n1 long")


@dataclass(frozen=True)
class Model:
    """Log-likelihood differences, toxic less ordinary, of seen grams and of contexts for unseen letters; keys (`gram_keys`) are sorted."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray

    def of_words(self, words: list[str]) -> np.ndarray:
        """Each word's log-likelihood as toxic less that as ordinary."""
        out = [np.zeros(0)]
        for at in range(0, len(words), WORDS):
            n, grams, contexts = _word_keys(words[at : at + WORDS])
            seen, value = _find(self.grams, self.ratios, grams)
            rest = np.flatnonzero(~seen)
            value[rest] = _find(self.contexts, self.unseen, contexts[rest])[1]
            out.append(np.bincount(np.repeat(np.arange(len(n)), n), value, len(n)))
        return np.concatenate(out)


#: Words whose letters are looked up at once.
WORDS = 20_000
#: A gram's key is the sum of its letters' scrambled code points times falling powers of this, modulo 2^64.
BASE = 0xD1342543DE82EF95
POWERS = [np.uint64(pow(BASE, d, 1 << 64)) for d in range(ORDER)]


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: each one's length, and every letter's scrambled code point and place in its text."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return n, mix(code.astype(np.uint64) + np.uint64(1)), np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)


def _before(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The key of the letters before each letter, at most ORDER - 1 of them."""
    out = np.zeros(len(code), np.uint64)
    for d in range(1, ORDER):
        out[d:] += np.where(place[d:] >= d, code[:-d] * POWERS[d - 1], np.uint64(0))
    return out


def _word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the number of its `_grams`, and one after another their keys and those of their contexts."""
    n, code, place = _letters([START + w + END for w in words])
    context = _before(code, place)
    ends = place > 0
    return n - 1, (code + context * POWERS[1])[ends].view(np.int64), context[ends].view(np.int64)


def gram_keys(grams: list[str]) -> np.ndarray:
    """Keys of grams of at most ORDER letters, the empty one included."""
    n, code, place = _letters(grams)
    out = np.zeros(len(grams), np.uint64)
    full = n > 0
    out[full] = (code + _before(code, place) * POWERS[1])[np.cumsum(n)[full] - 1]
    return out.view(np.int64)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted keys there are, and their values (0 for others)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    distinct, place = np.unique(wanted, return_inverse=True)  # sorted, so that neighbours are found near each other
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    there = keys[at] == distinct
    return there[place], np.where(there, values[at], 0.0)[place]


def fit(table: pa.Table) -> Model:
    """The model of `hashed` grams: some tens of bytes each, whatever their letters."""
    order = np.argsort(table.column("gram").to_numpy())
    gram, context, tail, size, top = (table.column(c).to_numpy()[order] for c in ("gram", "context", "tail", "size", "top"))
    shorter = np.searchsorted(gram, tail)  # every tail of a longer gram is a gram itself
    left = np.bincount(shorter[size > 1], minlength=len(gram))  # different letters on the left
    lower = np.flatnonzero(left)
    known, own = np.unique(context[lower], return_inverse=True)
    total, kinds = np.bincount(own, left[lower], len(known)), np.bincount(own, minlength=len(known))
    rest = (DISCOUNT * kinds / total)[own]
    share = np.maximum(left[lower] - DISCOUNT, 0) / total[own]
    backoff = np.zeros(len(gram))
    for k in range(1, ORDER):
        at = size[lower] == k
        rows = lower[at]
        below = 1 / max(1, len(rows) + 1) if k == 1 else backoff[shorter[rows]]  # as many letters as single grams, and an unseen one
        backoff[rows] = share[at] + rest[at] * below
    held, own = np.unique(context[top], return_inverse=True)
    low, p, weights = backoff[shorter[top]], [], []
    for c in ("n0", "n1"):
        n = table.column(c).to_numpy()[order[top]].astype(np.float64)
        mass, seen = np.bincount(own, n, len(held)), np.bincount(own, n > 0, len(held))
        weights.append(np.where(mass > 0, DISCOUNT * seen / np.maximum(mass, 1), 1.0))
        p.append(np.maximum(n - DISCOUNT, 0) / np.maximum(mass, 1)[own] + weights[-1][own] * low)
    return Model(gram[top], np.log(p[1] / p[0]), held, np.log(weights[1] / weights[0]))


def learn(grams: DataFrame) -> Model:
    """Fit in one task: the sample bounds the grams, and the driver gets no more than two numbers for each entry of the model."""

    def run(batches):
        held = list(batches)
        if held:
            m = fit(pa.Table.from_batches(held))
            for unseen, keys, values in ((False, m.grams, m.ratios), (True, m.contexts, m.unseen)):
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), unseen)), pa.array(keys[part]), pa.array(values[part])], ["unseen", "key", "value"])

    rows = hashed(grams).repartition(1).mapInArrow(run, "unseen boolean, key long, value double").toArrow()
    unseen, key, value = (rows.column(c).to_numpy() for c in ("unseen", "key", "value"))
    parts = []
    for which in (~unseen, unseen):
        k, v = key[which], value[which]
        order = np.argsort(k)
        parts += [k[order], v[order]]
    return Model(*parts)


class Ratios(dict):
    """Ratios of words, kept between batches; starts afresh beyond `limit` words."""

    def __init__(self, model: Model, limit: int = 300_000) -> None:
        super().__init__()
        self.model, self.limit = model, limit

    def learn(self, words: set[str]) -> None:
        if len(self) > self.limit:
            self.clear()
        new = list(words - self.keys())
        self.update(zip(new, self.model.of_words(new).tolist(), strict=True))


def features(texts: list[str | None], known: Ratios) -> np.ndarray:
    """Length-normalised difference; its part above EASY; share and number of strong words; length."""
    out = np.zeros((len(texts), 5))
    every = [expressions(text) for text in texts]
    known.learn(set().union(*every))  # all at once: a look-up costs little for many words, and much for few
    for i, found in enumerate(every):
        n = len(found)
        if n:
            r = np.fromiter(map(known.__getitem__, found), np.float64, n)
            strong = int((r > STRONG).sum())
            size = n + SHRINK
            out[i] = r.sum() / size, np.clip(r - EASY, 0, MOST).sum() / size, strong / size, np.log1p(strong), np.log1p(n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (intercept last), centre and scale of a ridge logistic curve, by Newton's method."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.r_[np.ones(x.shape[1]), 0.0] * max(1, len(x)) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, from the text alone.

    Labels outside 0 and 1 are ignored, repeated labels count as often as they occur. Without labelled
    documents of both classes every score is the share of toxic ones (0.5 without any). Empty and null
    texts get the curve's value at no evidence. Other columns are not read.
    """
    scored = with_score(docs.select("doc_id", "text"), docs, labels, folds, "score")
    return scored.select(
        "doc_id", (~learns("doc_id", folds)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def with_score(df: DataFrame, docs: DataFrame, labels: DataFrame, folds: int, name: str) -> DataFrame:
    """`df` with the score of its `text`; the model is learned from `docs` and `labels`."""
    spark = df.sparkSession
    chosen = sample(labels, docs, folds)
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    prior = sizes.get(1, 0) / n if n else 0.5
    fitted = learn(gram_counts(chosen)) if len(sizes) == 2 else Model(*[np.empty(0)] * 4)
    model = spark.sparkContext.broadcast((fitted.grams, fitted.ratios, fitted.contexts, fitted.unseen))

    def measure(batches):
        known = Ratios(Model(*model.value))
        for batch in batches:
            x = features(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c) for c in x.T)], ["toxic", *"abcde"])

    curve = None
    if len(sizes) == 2:
        held = chosen.where("curve").select("toxic", "text").mapInArrow(measure, "toxic int, " + ", ".join(f"{c} double" for c in "abcde")).toPandas()
        if held["toxic"].nunique() < 2:  # too few labels to spare some for the curve
            held = chosen.select("toxic", "text").mapInArrow(measure, "toxic int, " + ", ".join(f"{c} double" for c in "abcde")).toPandas()
        curve = logistic(held[list("abcde")].to_numpy(), held["toxic"].to_numpy())

    @F.pandas_udf("double")
    def judge(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Ratios(Model(*model.value))
        for texts in series:
            if curve is None:
                yield pd.Series(np.full(len(texts), prior))
                continue
            w, centre, scale = curve
            x = (features(texts.tolist(), known) - centre) / scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return df.withColumn(name, judge("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays below `threshold`."""
    name = "__toxicity"
    return with_score(docs, docs, labels, folds, name).where(F.col(name) < threshold).drop(name)
