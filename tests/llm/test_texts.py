"""Near duplicates, repeated lines and decontamination against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontam, lines, minhash
from tallyspark.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = set()
    for held in holders.values():
        for a in held[:40]:
            for b in held:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        label[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    big = float("inf")
    least = {r: min((d for d in g if d is not None), default=None, key=lambda d: big if d is None else d) for r, g in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates_equal_brute_force(docs, odd):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(both).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours are near, the ends are not: hubs alone would not link all of them."""
    rows = [(i, " ".join(f"t{k}" for k in range(3 * i, 3 * i + 60))) for i in range(30)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_kept_rows_keep_all_columns(odd):
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [90_900, 90_901, 90_902, 90_903, 90_904, 90_905, 90_905, 90_907, 90_908, 90_909] and None in ids


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (45, 2))] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: label[n] for n in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows, least):
    """Removed lines by (doc_id, text), from the longest earlier copy at each position."""
    rows = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, 0))
    text = [(d, t, (t or "").split("\n")) for d, t in rows]
    where, out = {}, {}
    for d, (_, _, ls) in enumerate(text):
        for i, line in enumerate(ls):
            where.setdefault(line, []).append((d, i))
    for d, (doc, t, ls) in enumerate(text):
        gone = set()
        for i, line in enumerate(ls):
            best = 0
            for e, j in where[line]:
                if (e, j) >= (d, i):
                    break
                other, n = text[e][2], 0
                while i + n < len(ls) and j + n < len(other) and ls[i + n] == other[j + n]:
                    n += 1
                best = max(best, n)
            if sum(len(x.split()) for x in ls[i : i + best]) >= least:
                gone |= set(range(i, i + best))
        out[(doc, t)] = sorted(gone)
    return out


@pytest.mark.parametrize("least", [50, 8])
def test_repeated_lines_equal_brute_force(docs, odd, least):
    # One text per id here: the order of several texts under one id is by hash.
    both = docs.select("doc_id", "text").union(odd.where("doc_id <> 90905 OR text LIKE 'alpha%' OR doc_id IS NULL").select("doc_id", "text"))
    want = brute_lines([(r["doc_id"], r["text"]) for r in both.collect()], least)
    got = lines.drop_repeated_lines(both, least).collect()
    assert len(got) == both.count()
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in got:
        removed = want[(r["doc_id"], texts[r["doc_id"]])]
        assert r["removed"] == removed
        before = texts[r["doc_id"]]
        assert r["text"] == (before if not removed else "\n".join(x for i, x in enumerate(before.split("\n")) if i not in removed))


def test_repeated_lines_inside_one_document_and_empty_table(spark, odd):
    block = "\n".join(BASE_LINES)
    rows = [(1, block + "\nbetween\n" + block + "\n" + block)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.drop_repeated_lines(df).first()["text"] == block + "\nbetween"
    assert lines.drop_repeated_lines(df.where("false")).count() == 0
    assert lines.drop_repeated_lines(odd).columns == [c for c in odd.columns if c != "removed"] + ["removed"]


BASE_LINES = [f"line {i} with some words in it {i}" for i in range(12)]


def test_line_dedup_runs_no_python(docs):
    plan = lines.drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_contaminated(docs, items, share):
    found = set()
    for doc_id, text in docs:
        words = decontam.normalised(text)
        for item_id, item_text in items:
            item = decontam.normalised(item_text)
            if len(item) >= decontam.SHORTEST:
                row = [0] * (len(words) + 1)
                for i, w in enumerate(item, 1):
                    new = [i]
                    for j, x in enumerate(words, 1):
                        new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
                    row = new
                if min(row) <= decontam.allowance(len(item), share):
                    found.add((doc_id, item_id, min(row)))
    return found


def test_contaminated_documents_are_found(spark, docs, odd):
    rng = np.random.default_rng(1)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()][:12]
    hosts = [r["text"] for r in docs.where("n_chars < 1500").orderBy("doc_id").limit(24).collect()]
    planted = []
    for i, host in enumerate(hosts):
        words, item = host.split(" "), decontam.normalised(items[i % 12][1])
        for _ in range(i % 4 * len(item) // 20):
            at = int(rng.integers(1, len(item)))
            item[at : at + 1] = [["zz"], [], [item[at], "yy"]][int(rng.integers(3))]
        planted.append((5_000 + i, " ".join(words[:20] + item + words[20:])))
    table = spark.createDataFrame(planted, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (77, None), (78, "two words"), (79, "")], "item_id long, text string")
    want = brute_contaminated(planted, items, 0.2)
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.contaminated(table, bench).collect()}
    assert got == want and len(want) >= 20
    assert decontam.contaminated(odd, bench).count() == 0
    assert decontam.contaminated(table, bench.where("false")).count() == 0
    left = decontam.drop_contaminated(odd.unionByName(table, allowMissingColumns=True), bench)
    assert left.columns == odd.columns and left.count() == odd.count() + len(planted) - len({d for d, _, _ in want})


def test_no_copy_within_the_allowance_is_missed():
    """Copies with all the edits that are allowed, in any place, the first word included, by item length."""
    rng = np.random.default_rng(3)
    for n in (15, 30, 59, 100, 150, 200):
        item = [f"w{x}" for x in rng.integers(0, 5_000, n)]
        index = decontam.Index([(1, " ".join(item))], 0.2)
        edits = decontam.allowance(n, 0.2)
        copies = []
        for c in range(100):
            copy = list(item)
            for e in range(edits):
                at = int(rng.integers(len(copy))) if c % 4 or e else 0
                copy[at : at + 1] = [["zz"], [], [copy[at], "yy"]][int(rng.integers(3))]
            copies.append([f"a{x}" for x in range(7)] + copy + ["b"] * 9)
        found = index.search(copies)
        assert len(found) == len(copies) and max(x[4] for x in found) <= edits, n


def test_short_items_match_exact_runs_of_words():
    items = [(1, "Why?"), (2, "What is love"), (3, "is it"), (4, "one two three four"), (5, "!"), (6, None)]
    docs = ["so why not", "what, IS love: is it", "what is a love", "one two three x four", "zero one two three four five", "is", "it is", "that is", "it and what", "is love", ""]
    for share in (0.2, 0.5):
        found = decontam.Index(items, share).search([decontam.normalised(d) for d in docs])
        # "why"; "what is love" and "is it" beside it; all four words. Runs that go over the end of a document are none.
        assert {(d, items[i][0], first, n, e) for d, i, first, n, e in found} == {(0, 1, 1, 1, 0), (1, 2, 0, 3, 0), (1, 3, 3, 2, 0), (4, 4, 1, 4, 0)}


def test_equal_documents_in_bulk_change_nothing(spark):
    """Words that are frequent because of copies are no longer rare; the matches stay."""
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, "before it " + item + " after it") for i in range(800)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("edits = 0").count() == 800


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for shared in (4000, 3000, 0):
        other = np.concatenate([base[:shared], rng.integers(0, 2**63, 4000 - shared, dtype=np.uint64)])
        a, b = minhash.minima([np.unique(base), np.unique(other)])
        real = shared / (8000 - shared)
        assert abs((a == b).mean() - real) < 0.2


def test_lost_text_hash_does_not_collide(odd):
    hashed = odd.select("doc_id", F.xxhash64("text").alias("h")).where("text IS NOT NULL").distinct()
    assert hashed.select("h").distinct().count() == hashed.select("h").count()
