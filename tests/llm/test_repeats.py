"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import queries, repeats  # noqa: F401
from tallyspark.llm.registry import QUERIES


def brute(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(x[s : s + length] for _, x in data for s in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x) + 1)
        for s in range(len(x) - length + 1):
            if count[x[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(gone[i] > gone[i - 1] for i in range(len(x)))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, length, **options):
    rows = repeats.cut_repeats(docs, length, **options).collect()
    return sorted(
        ((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows),
        key=str,
    )


def shared_texts(rng, n, length):
    """Texts that share pieces shorter, as long and longer than `length`, with edits, runs and periods in them."""
    pieces = ["".join(rng.choices("abcdé 漢", k=rng.randint(length // 3, 2 * length))) for _ in range(6)]
    texts = ["", None, "x" * (3 * length), "x" * (length - 1), "ab" * length, "ab" * length + "c", "é" * length]
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 6)):
            piece = rng.choice(pieces)
            low = rng.randint(0, len(piece))
            text += rng.choice([piece, piece[low:], piece[:low], "".join(rng.choices("abcdefgh ", k=rng.randint(0, length)))])
        texts.append(text)
    return [(i % (n // 2 + 3), t) for i, t in enumerate(texts)] + [(None, texts[-1]), (0, texts[-1])]


@pytest.mark.parametrize("length,gram,bucket", [(24, 6, 2048), (24, 6, 2), (40, 33, 5)])
def test_equals_brute_force(spark, length, gram, bucket):
    rows = shared_texts(random.Random(length + bucket), 120, length)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, removed int")
    assert found(docs, length, gram=gram, bucket=bucket) == brute(rows, length)


def test_query_on_odd_documents(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_suffix_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 200)


def test_query_on_whole_table(spark, docs):
    got = QUERIES["op12_suffix_dedup"](spark, "/root/testdata/sf0.01").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 200)


def test_empty_table(spark, odd):
    assert repeats.cut_repeats(odd.limit(0)).count() == 0


def test_suffixes_sort_like_bytes():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(400)]
    bucket = np.array([rng.randint(0, 20) for _ in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - np.array([len(t) for t in texts])
    sorted_ = repeats.Suffixes(data, start, end, bucket, 12)
    assert [(bucket[i], texts[i][:12]) for i in sorted_.order] == sorted((b, t[:12]) for b, t in zip(bucket, texts))


def test_collisions_are_found(monkeypatch):
    """A hash that says everything is equal is not believed; the next one is taken."""
    real = repeats.Hasher.of
    calls = []

    def weak(self, sums, start, end):
        calls.append(self)
        return real(self, sums, start, end) if self is not repeats._hasher(3) else np.zeros(len(start), np.uint64)

    monkeypatch.setattr(repeats.Hasher, "of", weak)
    texts = [b"banana", b"bandana", b"apple", b"band"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    held = repeats.Suffixes(data, end - np.array([len(t) for t in texts]), end, np.zeros(4, int), 8)
    assert [texts[i] for i in held.order] == sorted(texts) and held.hasher is repeats._hasher(4)

def test_windows_of_large_buckets_come_as_ranges(spark):
    """Neighbouring repeated windows of a context are one row, also where their bucket is too large to gather."""
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefgh", k=60))
    # Different contexts around one passage: what stands before and after it differs in each.
    rows = [(i, "".join(rng.choices("ijklmnop", k=30)) + shared + "".join(rng.choices("qrstuvwx", k=30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, 24, gram=6, bucket=2) == brute(rows, 24)
    contexts = spark.createDataFrame([(1, i, 18, 19, text[30:72].encode()) for i, (_, text) in enumerate(rows)], "g long, u long, o int, w int, context binary")
    assert sorted(map(tuple, repeats._counted(contexts, 24).select("g", "u", "low", "high").collect())) == [(1, i, 0, 18) for i in range(40)]


def test_equal_blocks_of_large_buckets_are_not_told_window_by_window(spark, monkeypatch):
    """What many contexts share whole is counted by blocks; windows are named where blocks differ, once for equal ones."""
    rng = random.Random(7)
    named = spark.sparkContext.accumulator(0)
    real = repeats._name_windows

    def watched(*given):
        name = real(*given)

        def run(batches):
            for batch in name(batches):
                named.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(repeats, "_name_windows", watched)
    shared = "".join(rng.choices("abcdefgh", k=42))
    edits = [shared[:k] + "z" + shared[k + 1 :] for k in (0, 1, 5, 40, 41)]  # the anchor at 18 stays
    texts = [shared[:-1] + "y", *edits, *[shared + "x" * i for i in range(200)]]
    # 200 contexts with the same windows, and six that differ at an end.
    contexts = spark.createDataFrame([(1, i, 18, 19, x[:42].encode()) for i, x in enumerate(texts)], "g long, u long, o int, w int, context binary")
    got = {}
    for r in repeats._counted(contexts, 24).collect():
        got.setdefault(r["u"], set()).update(range(r["low"], r["high"] + 1))
    count = Counter(x[s : s + 24] + str(s) for x in (t[:42] for t in texts) for s in range(19))
    want = {i: {s for s in range(19) if count[x[s : s + 24] + str(s)] > 1} for i, x in enumerate(texts)}
    assert got == {i: s for i, s in want.items() if s}
    assert 0 < named.value < 19 * 8  # not 19 for each of 206 contexts
