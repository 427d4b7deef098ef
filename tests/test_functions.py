"""Shared patterns against brute force on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.intervals import TOP, bounded, clipped, first_overlapping, levels_for
from tallyspark.functions.ordered import latest_before, row_numbers, running
from tallyspark.functions.quantiles import interpolated, med_mid, med_upper, q_ceil, q_floor, rank_pick


@pytest.mark.parametrize("n", [0, 1, 2, 3, 20])
def test_five_quantile_dialects(spark, n):
    values = [float((i * 7) % 20) - 5 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = sorted(values)
    picks = {"floor": q_floor(0.33), "ceil": q_ceil(0.9), "upper": med_upper}
    row = rank_pick(df, "v", picks, count_as="n").first()
    assert row["n"] == n
    if n == 0:
        assert row["floor"] is None
        return
    assert row["floor"] == s[math.floor(n * 0.33)]
    assert row["ceil"] == s[max(0, math.ceil(0.9 * n) - 1)]
    assert row["upper"] == s[n // 2]
    at = (n - 1) * 0.9
    low, high = s[math.floor(at)], s[math.ceil(at)]
    assert interpolated(df, "v", {"p90": 0.9}).first()[0] == pytest.approx(low + (high - low) * (at % 1))
    middle = (s[(n - 1) // 2] + s[n // 2]) / 2
    assert med_mid(df, "v", "m").first()[0] == pytest.approx(middle)


def test_running_and_ranks_follow_the_whole_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(50), i, rng.randrange(-5, 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, i long, x long")
    order = [F.col("t"), F.col("i")]
    out = running(df, ["k"], F.floor(F.col("t") / 7), order, {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))})
    back = running(df, ["k"], F.floor(F.col("t") / 7), order, {"r": ("min", F.col("x"))}, reverse=True)
    ranks = row_numbers(df, ["k"], F.floor(F.col("t") / 7), order)
    got = {r["i"]: r for r in out.collect()}
    low = {r["i"]: r["r"] for r in back.collect()}
    rank = {r["i"]: r["rank"] for r in ranks.collect()}
    for key in "ab":
        mine = sorted((t, i, x) for k, t, i, x in rows if k == key)
        for place, (_, i, _) in enumerate(mine):
            xs = [x for _, _, x in mine]
            assert got[i]["s"] == sum(xs[: place + 1])
            assert got[i]["m"] == max(xs[: place + 1])
            assert low[i] == min(xs[place:])
            assert rank[i] == place + 1


def test_latest_before_includes_the_same_instant(spark):
    probes = spark.createDataFrame([("f", t) for t in (5, 10, 86_400_020, 86_400_020)], "k string, ts long")
    marks = spark.createDataFrame([("f", 10), ("f", 15), ("g", 1)], "k string, ts long")
    got = {(r["ts"], r["m"]) for r in latest_before(probes, marks, ["k"], "ts", "m").collect()}
    assert got == {(5, None), (10, 10), (86_400_020, 15)}


def test_overlaps_match_pairwise_comparison(spark):
    rng = random.Random(11)
    rows = {}
    while len(rows) < 120:
        start = rng.randrange(0, 300)
        end = rng.choice([start, start + rng.randrange(0, 40), TOP, TOP - 1])
        rows.setdefault((rng.randrange(2), rng.randrange(3), start, end), rng.randrange(10_000))
    data = [(*k, v) for k, v in rows.items()]
    df = spark.createDataFrame(data, "k int, e int, s long, t long, label long")
    df = df.withColumn("levels", F.lit(31))
    out = first_overlapping(df, ["k"], "e", "s", "t", "label", "inner_first", "first", "levels").collect()
    assert len(out) == len(data)
    for r in out:
        hits = [(e, v) for k, e, s, t, v in data if k == r["k"] and s <= r["t"] and r["s"] <= t]
        assert r["first"] == min(v for _, v in hits)
        assert r["inner_first"] == min(v for e, v in hits if e == r["e"])


def test_lines_beyond_int_range_overlap_only_where_they_meet(spark):
    base = 2**53
    rows = [(2**31 + 5, 2**31 + 9), (2**31 + 10, 2**31 + 12), (base + 1, base + 1), (base + 2, base + 3), (base + 3, TOP), (2**62, 2**62 + 1), (0, 2**31 + 4)]
    df = spark.createDataFrame([("f", 0, *r, i) for i, r in enumerate(rows)], "k string, e int, s long, t long, label long")
    df = df.withColumn("s", bounded(F.col("s"))).withColumn("t", bounded(F.col("t")))
    df = df.withColumn("t", clipped(F.col("t"), F.lit(2**62 + 1))).withColumn("levels", levels_for(F.lit(2**62 + 1)))
    out = first_overlapping(df, ["k"], "e", "s", "t", "label", "inner_first", "first", "levels").collect()
    got = {r["s"]: r["first"] for r in out}
    assert got == {s: min(i for i, (a, b) in enumerate(rows) if a <= t and s <= b) for s, t in rows}


def test_resampled_multiplicities_are_poisson():
    import numpy as np

    from tallyspark.functions import draws

    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, draws.PRIME, (2, 400))
    counts = draws.multiplicities(h1, h2, draws.coefficients(5, 600))
    assert (counts[:, 0] == 1).all()
    drawn = counts[:, 1:]
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03 and drawn.max() > 5
    # Units are independent: sums over all of them spread as n independent counts do.
    assert abs(drawn.sum(0).var() / 400 - 1) < 0.2
    assert len(draws.poisson_steps()) > 10 and draws.poisson_steps()[-1] < draws.PRIME


def test_path_spellings_agree(spark):
    spellings = ["file:///C%3A/Work//A.py", "c:\\work\\a.py", " /c:/Work/A.py "]
    df = spark.createDataFrame([(p,) for p in spellings], "p string")
    assert {r[0] for r in df.select(S.canonicalise_path(F.col("p"))).collect()} == {"c:/work/a.py"}
    odd = spark.createDataFrame([("/a/100%.txt",), ("/a/b+c.txt",)], "p string")
    assert {r[0] for r in odd.select(S.canonicalise_path(F.col("p"))).collect()} == {"/a/100%.txt", "/a/b+c.txt"}


def test_overlap_listing_is_shuffled_once(spark):
    """The ranges listed under their blocks meet in one shuffle, and the minima per range in a second one."""
    rng = random.Random(11)
    rows = sorted({(rng.choice("ab"), rng.randrange(3), low, low + rng.randrange(9)) for low in (rng.randrange(60) for _ in range(150))})
    rows = [(*r, i * 37 % 1009) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, e long, s long, t long, label long").withColumn("levels", F.lit(7))
    out = first_overlapping(df, ["k"], "e", "s", "t", "label", "inner_first", "first", "levels")
    got = {(r["k"], r["e"], r["s"], r["t"]): (r["inner_first"], r["first"]) for r in out.collect()}
    meets = lambda a, b: a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]
    want = {a[:4]: (min(b[4] for b in rows if meets(a, b) and a[1] == b[1]), min(b[4] for b in rows if meets(a, b))) for a in rows}
    assert got == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    whole = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and whole.count("Exchange hashpartitioning") == 2
