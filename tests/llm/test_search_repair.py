"""Ranked search and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import conversations, queries, search  # noqa: F401
from tallyspark.llm.registry import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=50):
    held = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, words = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in terms}
        scores = []
        for d, w in held:
            m = 50 + 50 * len(w) * n // words
            score = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(index, n, items, k=50):
    return sorted((tuple(r) for r in search.search(index, n, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items(spark, odd):
    rows = [(1, "alpha1 beta1 eps3 readable"), (2, None), (3, ""), (4, "?!"), (5, "Ünïcode don't 漢字 3.14 IT"), (6, "absent"), (6, "gamma1 gamma2 gamma2 delta4")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_equals_brute_force(spark, odd, items, k, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    index, n = search.build_index(odd)
    assert got(index, n, items, k) == ranked(docs, [(r["item_id"], r["text"]) for r in items.collect()], k)


def test_search_of_ties_and_many_strata(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=1 + i % 40))) for i in range(600)] + [(7, "a b"), (7, "a b"), (None, "a b")]
    asked = [(i, " ".join(rng.sample("abcdefghijk", 4))) for i in range(12)]
    index, n = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(index, n, spark.createDataFrame(asked, "item_id long, text string")) == ranked(docs, asked)
    pieces = index.where("term IS NULL")
    assert pieces.select(F.sum(F.size("doc_ids"))).first()[0] == n
    assert pieces.groupBy("group", "piece").count().where("count > 1").count() == 0


def test_search_of_nothing(spark, odd, items):
    empty, n = search.build_index(odd.limit(0))
    assert n == 0 and got(empty, n, items) == []
    index, n = search.build_index(odd)
    assert got(index, n, items.limit(0)) == []


def test_small_pieces_give_the_same(spark, odd):
    """Pieces and groups of a few documents, cut in the middle of a stratum."""
    import pyarrow as pa

    docs = [(i, f"a{i % 3} b c{i % 5} {'d ' * (i % 4)}") for i in range(50)]
    forward = [search._tokenize([pa.RecordBatch.from_pylist([{"row": i, "doc_id": d, "text": t} for i, (d, t) in enumerate(docs)])])]
    (batch,) = forward[0]
    ms = sorted(range(50), key=lambda i: (i % 4, i))
    batch = batch.take(pa.array(ms)).append_column("m", pa.array([50 + i % 4 for i in ms]))
    old = search.PIECE, search.GROUP_DOCUMENTS
    search.PIECE, search.GROUP_DOCUMENTS = 3, 7
    try:
        from unittest.mock import patch

        with patch.object(search, "TaskContext") as task:
            task.get.return_value.partitionId.return_value = 1
            rows = [r for b in search._cut([batch.slice(0, 20), batch.slice(20)]) for r in b.to_pylist()]
    finally:
        search.PIECE, search.GROUP_DOCUMENTS = old
    places = {(r["group"], r["piece"]): r["doc_ids"] for r in rows if r["doc_ids"]}
    assert sorted(d for ids in places.values() for d in ids) == list(range(50)) and max(map(len, places.values())) == 3
    back = sorted((places[r["group"], r["piece"]][s], r["term"], r["tf"]) for r in rows if not r["doc_ids"] for s in r["slots"])
    assert back == sorted((d, t, search.terms_of(x.encode()).count(t.encode())) for d, x in docs for t in set(x.split()))


# ---- conversation repair

WANTED = re.compile("(s?(ua)+)?")
STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(kinds):
    """Least (cost, audit) over all edits: Dijkstra over (rows done, last role), the whole audit in the key."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(kinds) and last in ("", "a"):
            return audit, cost
        ways = [(2, "I", i, r) for r in STEP[last] if r in "ua"]
        if i < len(kinds):
            k, open_end = kinds[i].lower(), int(kinds[i].isupper())
            ways += [(3, "D", i + 1, last)]
            if k != "d":
                ways += [(open_end, "K", i + 1, k)] if k in STEP[last] else []
                ways += [(2 + open_end, "R", i + 1, r) for r in STEP[last] if r in "ua"]
        for c, letter, j, r in ways:
            heapq.heappush(heap, (cost + c, audit + letter, j, r))


def test_edits_equal_exhaustive_search():
    for n in range(5):
        for kinds in itertools.product("suaxUAd", repeat=n):
            assert conversations.audit_of("".join(kinds), 0, None) == cheapest("".join(kinds)), kinds
    rng = random.Random(1)
    for n in [8, 17, 40]:
        for _ in range(60):
            kinds = "".join(rng.choices("suaxSUAXd", k=n))
            assert conversations.audit_of(kinds, 0, None) == cheapest(kinds), kinds


def brute(rows):
    """The contract read row by row: rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        way = zlib.crc32(key.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x
        r = "user" if way == 4 else r
        convs[c] += [(t is not None, t or 0, r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = []
    for c, held in convs.items():
        held.sort()
        faults, kinds, seen = [], "", set()
        for _, _, r, x in held:
            bare = x.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "none"
            seen.add((r, x))
            faults.append(fault)
            initial = r[:1] if r[:1] and r[:1] in "sua" else "x"
            kinds += "d" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial
        audit, cost = cheapest(kinds)
        lines, last, at = [], "", 0
        for letter in audit:
            if letter in "IR":
                last = "a" if last == "u" else "u"
                role = {"u": "user", "a": "assistant"}[last]
            elif letter == "K":
                role, last = held[at][2], held[at][2][:1]
            if letter != "D":
                lines.append(f"{role}:{'' if letter == 'I' else held[at][3]}")
            at += letter != "I"
        assert WANTED.fullmatch("".join(x[0] for x in lines)), (kinds, audit)
        turns = [t for known, t, _, _ in held if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_rows():
    rng = random.Random(3)
    rows = [(None, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 4, "assistant", None), (2, 9, "", "no role."), (3, 5, None, "x")]
    rows += [(4, t, "user", "same.") for t in range(30)] + [(5, 1, "user", "a?"), (5, 1, "assistant", "b!"), (5, 1, "user", "c. \x0b\n")]
    rows += [(6, t, rng.choice(["user", "assistant", "system", "User", "sys", "tool"]), rng.choice(["Yes.", "no", " \t", "", "ok! ", "q?\x85", "end。"])) for t in range(200)]
    return rows + [(7, 2**40, "user", "far."), (7, -3, "assistant", "near."), (8, 1, "user", "w." * 50_000)]


def write(spark, rows, path):
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").write.parquet(f"{path}/conversations.parquet")


def test_query_equals_brute_force(spark, tmp_path):
    rows = odd_rows()
    write(spark, rows, str(tmp_path))
    found = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_query_on_whole_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01").select(COLUMNS).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute([tuple(r) for r in given.collect()])


@pytest.mark.parametrize("fan", [2, 5])
def test_blocks_give_the_same(spark, fan):
    rows = spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string")
    whole = conversations.report(conversations.repair(rows)).collect()
    cut = conversations.report(conversations.repair(rows, fan)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))


def test_empty_conversations(spark, tmp_path):
    write(spark, [], str(tmp_path))
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 0
