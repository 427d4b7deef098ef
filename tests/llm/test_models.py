"""Scores learned from the tables, and near vectors."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import embeddings, lm, toxicity
from tallyspark.llm.common import learns


def held_out(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 1


def test_toxicity_separates_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    own = scored[scored["held_out"]]
    assert all(held_out(d, 3) == h for d, h in zip(scored["doc_id"], scored["held_out"], strict=True))
    order = own["score"].rank()
    n1, n0 = (own["toxic"] == 1).sum(), (own["toxic"] == 0).sum()
    area = (order[own["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    flagged = own[own["predicted"] == 1]
    print("area", area, "precision", (flagged["toxic"] == 1).mean(), "recall", (flagged["toxic"] == 1).sum() / n1)
    # Some labels contradict their text, in both directions.
    assert area > 0.93 and (flagged["toxic"] == 1).mean() > 0.9


def test_toxicity_never_sees_labels_of_the_fold_or_other_columns(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(learns("doc_id", 3), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({(r["doc_id"]): r["score"] for r in toxicity.score_documents(docs.withColumn("lang", F.lit(x)), y).collect()} for x, y in (("en", labels), ("xx", flipped)))
    assert a == pytest.approx(b)
    none = toxicity.score_documents(odd, labels.where("false")).collect()
    assert len(none) == odd.count() and {r["score"] for r in none} == {0.5}
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns


def plain_model(counts):
    """Ratios by gram and by context from the definition, over dictionaries of strings."""
    left = Counter(g[1:] for g in counts if len(g) > 1)
    letters = sum(len(g) == 1 for g in left) + 1

    def shared(gram):
        if not gram:
            return 1 / letters
        after = [n for g, n in left.items() if g[:-1] == gram[:-1] and g]
        return (max(left[gram] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * shared(gram[1:])) / sum(after)

    top = [g for g in counts if len(g) == toxicity.ORDER or (g[0] == toxicity.START and len(g) > 1)]
    ratios, contexts = {}, {}
    for gram in top:
        p, weights = [], []
        for c in (0, 1):
            after = [counts[g][c] for g in top if g[:-1] == gram[:-1]]
            mass = sum(after)
            weights.append(toxicity.DISCOUNT * sum(n > 0 for n in after) / mass if mass else 1.0)
            p.append(max(counts[gram][c] - toxicity.DISCOUNT, 0) / max(mass, 1) + weights[c] * shared(gram[1:]))
        ratios[gram], contexts[gram[:-1]] = math.log(p[1] / p[0]), math.log(weights[1] / weights[0])
    return ratios, contexts


def test_kneser_ney_ratios_equal_a_plain_model(spark):
    counts = {}
    known = (("ab", 3, 0), ("ac", 1, 4), ("längere", 2, 1), ("langer", 0, 2), ("日本語", 1, 1), ("x", 5, 0))
    for word, a, b in known:
        for top in toxicity._grams(word):
            for k in range(len(top)):
                n = counts.setdefault(top[k:], [0, 0])
                n[0] += a
                n[1] += b
    grams = spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram string, n0 long, n1 long")
    model = toxicity.learn(grams)
    ratios, contexts = plain_model(counts)
    assert ratios[toxicity.START + "ab"] < 0 < ratios[toxicity.START + "ac"]
    words = [*(w for w, *_ in known), "zz", "abc", "langere", "é", "längerelangerab"]
    plain = [sum(ratios.get(g, contexts.get(g[:-1], 0.0)) for g in toxicity._grams(w)) for w in words]
    assert model.of_words(words) == pytest.approx(plain)
    assert plain[words.index("zz")] == pytest.approx(contexts[toxicity.START])
    assert len(model.of_words([])) == 0
    nothing = toxicity.learn(grams.where("false"))
    assert nothing.of_words(["ab"]).tolist() == [0.0]


def test_language_model_beats_unigrams_and_counts_exactly(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    train = Counter()
    for d, w in rows:
        if not held_out(d, 5):
            train.update([*w, b""])
    n, v = sum(train.values()), len(train)
    want = sorted(
        (str(d), held_out(d, 5), len(w) + 1, sum(train[x] > 0 for x in [*w, b""]), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, b""]), 4)) for d, w in rows
    )
    got = lm.score_documents(docs).toPandas()
    mine = sorted((("None" if d != d else str(int(d))), bool(h), t, k, c, round(b, 4)) for d, h, t, k, c, b in got[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]].itertuples(index=False))
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert [m[5] for m in mine] == pytest.approx([w[5] for w in want], abs=1e-3)
    own = got[got["held_out"]]
    assert own["score"].sum() > own["base_score"].sum()


def test_network_learns_from_every_training_document(spark):
    # The 3,000 first training documents by hash hold one pattern; only those beyond them hold the other.
    ids = spark.range(8_000).select(F.col("id").alias("doc_id"))
    first = ids.where(learns("doc_id", 5)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3_000).withColumn("first", F.lit(True))
    early, late = (" ".join(f"{x}{i % 5}" for i in range(20)) for x in "pq")
    docs = ids.join(first, "doc_id", "left").select("doc_id", F.when(F.col("first"), early).otherwise(late).alias("text"))
    own = lm.score_documents(docs).where("held_out").toPandas()
    gain = (own["score"] - own["base_score"]) / own["n_tokens"]
    assert len(own) > 1_000 and gain.min() > 0.7  # of 1.0: the place of each word tells the next


def test_windows_hold_every_token_once_and_in_order(monkeypatch):
    monkeypatch.setattr(lm, "LANES", 3)
    lengths = [1, 2, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 2 * lm.WINDOW, 400, 5, 0, 33]
    docs = [np.array([-1, *range(1000 * d, 1000 * d + n)]) for d, n in enumerate(lengths, 1)]
    told = [(before, x) for block in lm._blocks(iter(docs)) for lane in block.T for before, x in zip(lane[:-1], lane[1:]) if x >= 0]
    assert sorted(told) == sorted((before, x) for d in docs for before, x in zip(d[:-1], d[1:]))


def test_words_beyond_the_held_ones_come_by_the_join(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "ROUNDS", 0)
    full = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "HELD", lm.MODEL)
    monkeypatch.setattr(lm, "MODEL", lm.MODEL)
    few = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert all(few[d]["n_known"] == r["n_known"] and few[d]["score"] == pytest.approx(r["score"]) and few[d]["base_score"] == pytest.approx(r["base_score"]) for d, r in full.items())


def test_back_propagation_matches_differences():
    rng = np.random.default_rng(4)
    net = lm.Network(np.arange(1000, 0, -1.0), 50.0)
    for name in lm.Network.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.cls += rng.standard_normal(net.cls.shape) * 0.1
    net.out += rng.standard_normal(net.out.shape) * 0.1
    block = np.array([[-1, -1], [3, 700], [lm.MODEL, 5], [-1, 8], [4, 9]])
    seen = {}

    class Catch:
        def move(self, name, value, rows, gradient):
            seen.setdefault(name, np.zeros_like(value))[rows] += gradient

    def loss():
        h, total, live = np.zeros((2, lm.HIDDEN)), 0.0, 0
        for t in range(4):
            fresh = block[t] < 0
            token = np.where(fresh, lm.MODEL, block[t])
            h = np.where(fresh[:, None], 0, lm.step(net, token, np.where(fresh[:, None], 0, h))[0])
            want = block[t + 1]
            ok = want >= 0
            total -= lm.log_probabilities(net, h[ok], want[ok]).sum()
            live += ok.sum()
        return total / live

    lm._window(net, block, np.zeros((2, lm.HIDDEN)), Catch())
    for name, at in (("u", (3, 40)), ("embed", (3, 50)), ("bias", (60,)), ("cls", (2, 0)), ("out", (0, 5, 4)), ("cls_bias", (5,)), ("out_bias", (5, 60))):
        value = getattr(net, name)
        old = value[at]
        value[at] = old + 1e-4
        up = loss()
        value[at] = old - 1e-4
        down = loss()
        value[at] = old
        assert seen[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-3, rel=0.05)


def test_training_documents_are_written_once_as_numbers(spark, monkeypatch):
    kept, write = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df: kept.append(write(df)) or kept[-1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["A b\ta", None, "x", ""] * 5)], "doc_id long, text string")
    lm.fitted(docs, 5, 40, [b"a", b"", b"b"], lm.Network(np.array([10.0, 20.0, 5.0]), 5.0))
    ids = {0: [-1, 0, 2, 0, 1], 1: [-1, 1], 2: [-1, lm.MODEL, 1], 3: [-1, 1]}
    want = [ids[i % 4] for i in range(20) if not held_out(i, 5)]
    assert sorted(np.frombuffer(r["ids"], np.int16).tolist() for r in kept[0].collect()) == sorted(want)
    assert len(kept) == 1


def test_steps_over_lanes_equal_single_steps():
    rng = np.random.default_rng(3)
    net = lm.Network(np.arange(1000, 0, -1.0), 50.0)
    token, keep = rng.integers(0, lm.MODEL + 1, (9, 5)), rng.random((9, 5)) < 0.7
    h = rng.standard_normal((5, lm.HIDDEN)).astype(np.float32)
    states, gates, n, s = lm._run(net, token, keep, h)
    for t in range(9):
        assert states[t].T == pytest.approx(h, abs=1e-5)
        new, *parts = lm.step(net, token[t], h)
        assert [gates[t][: lm.HIDDEN].T, gates[t][lm.HIDDEN :].T, n[t].T, s[t].T] == [pytest.approx(x, abs=1e-5) for x in parts]
        h = new * keep[t][:, None]


def test_sums_far_apart_stay_finite():
    net = lm.Network(np.arange(1000, 0, -1.0), 50.0)
    net.cls_bias[3], net.out_bias[0, 1] = -500, 500
    h = np.zeros((3, lm.HIDDEN), np.float32)
    found = lm.log_probabilities(net, h, np.array([3 * lm.PER_CLASS, 0, 1]))
    assert np.isfinite(found).all() and found[0] < -400 and found[1] < -400 and found[2] > -10
    lm._window(net, np.array([[-1], [1], [3 * lm.PER_CLASS], [5]]), np.zeros((1, lm.HIDDEN), np.float32), lm._Adagrad())
    assert all(np.isfinite(getattr(net, name)).all() for name in net.NAMES)


def test_documents_are_scored_alone_and_whole():
    net = lm.Network(np.arange(1000, 0, -1.0), 50.0)
    net.out += 0.3
    docs = [np.random.default_rng(i).integers(0, 900, n) for i, n in enumerate([1, 5, 400, 70, 70])]
    together = lm.score(net, docs)
    assert together == pytest.approx([lm.score(net, [d])[0] for d in docs], rel=1e-4)


def brute_vectors(rows, threshold=0.98):
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float64)
            unit[i] = x / np.linalg.norm(x)
    links = {i: set() for i in range(len(rows))}
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j), links[j].add(i)
    label = {i: rows[i][0] for i in links}
    for _ in range(len(rows)):
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
        if new == label:
            break
        label = new
    return sorted((rows[i][0], len(links[i]), label[i], rows[i][0] == label[i]) for i in links)


def test_near_vectors_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    rng = np.random.default_rng(9)
    for k in range(60):  # a ring of near vectors: neighbours link, the others do not
        turn = 2 * math.pi * k / 60
        rows.append((9_000 + k, [math.cos(turn), math.sin(turn)] + [0.0] * 62, 3))
    rows += [(10_000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows += [(11_000, None, 1), (11_001, [0.0] * 64, 1), (11_002, [float("nan")] * 64, 1), (11_003, [None] * 64, 1), (11_004, rows[1][1], None), (11_005, [], 1), (11_006, [1.0, 2.0], 1), (11_007, [float("inf")] + [0.0] * 63, 1), (11_008, [1.0, 2.0], 1)]
    rows += [(12_000 + k, (np.array(rows[7][1]) + rng.standard_normal(64) * 0.02 * np.linalg.norm(rows[7][1]) / 8).tolist(), rows[7][2]) for k in range(20)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, cell string")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert got == brute_vectors(rows)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_pairs_across_cells_are_found(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 5)
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.repeat(rng.standard_normal((30, 6)), 10, 0) + rng.standard_normal((300, 6)) * 0.2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()) == brute_vectors(rows)


def test_words_of_a_batch_are_looked_up_at_once(monkeypatch):
    """A look-up for each document made scoring ten times as slow; keys of words are those of their grams."""
    words = ["ab", "längere", "日本語", "x", "langelange"]
    n, grams, contexts = toxicity._word_keys(words)
    tops = [g for w in words for g in toxicity._grams(w)]
    assert n.tolist() == [len(w) + 1 for w in words]
    assert grams.tolist() == toxicity.gram_keys(tops).tolist() and contexts.tolist() == toxicity.gram_keys([g[:-1] for g in tops]).tolist()
    assert len(set(toxicity.gram_keys([*set(tops), ""]).tolist())) == len(set(tops)) + 1
    asked, plain = [], toxicity.Model.of_words
    monkeypatch.setattr(toxicity.Model, "of_words", lambda model, w: asked.append(len(w)) or plain(model, w))
    key = toxicity.gram_keys([toxicity.START + "a"])
    one = toxicity.Model(key, np.array([4.0]), np.empty(0, np.int64), np.empty(0))
    got = toxicity.features(["a b", None, "", "b c a a"], toxicity.Ratios(one))
    assert asked == [3] and got[:, 3].tolist() == pytest.approx([math.log(2), 0, 0, math.log(3)])
