"""Exact ranks where values crowd in one bucket."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import quantiles as Q

RANKS = {"low": Q.q_floor(0.1), "median": Q.med_upper, "high": Q.q_ceil(0.95), "first": lambda n: F.lit(1), "last": lambda n: n}


def picks(values):
    held = sorted(v for v in values if v is not None)
    n = len(held)
    at = {"low": int(n * 0.1), "median": n // 2, "high": min(n, max(1, -(-n * 95 // 100))) - 1, "first": 0, "last": n - 1}
    return {k: held[i] for k, i in at.items()}


def crowds():
    rng = random.Random(4)
    return {
        "one value": [7.0] * 900 + [1.0, 2.0, None],
        "one bucket": [1000 + rng.random() / 1e6 for _ in range(900)] + [rng.uniform(-1e9, 1e9) for _ in range(100)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(500)] + [0.0, -0.0, 1.7e308, -1.7e308, 5e-324],
        "single": [3.5],
    }


def test_ranks_of_crowded_values(spark):
    rows = [(name, v) for name, values in crowds().items() for v in values]
    df = spark.createDataFrame(rows, "kind string, v double")
    found = {r["kind"]: r for r in Q.rank_pick(df, "v", RANKS, ["kind"], count_as="n").collect()}
    for name, values in crowds().items():
        assert {k: found[name][k] for k in RANKS} == picks(values), name
        assert found[name]["n"] == sum(v is not None for v in values)


def test_large_integers_keep_their_digits(spark):
    values = [2**62 + i for i in range(500)] + [-(2**62) - i for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = Q.rank_pick(df, "v", RANKS).first()
    assert {k: row[k] for k in RANKS} == picks(values)
    assert Q.rank_pick(df.limit(0), "v", RANKS).first()["median"] is None


@pytest.mark.parametrize("parts", [16])
def test_last_part_is_small(spark, parts, monkeypatch):
    """Of 20,000 distinct values in one logarithmic bucket, two divisions leave a few to be sorted."""
    monkeypatch.setattr(Q, "PARTS", parts)
    counts = spark.range(20_000).select((1000 + F.col("id") / 1e6).alias("_v"), F.lit(1).cast("long").alias("_c"), F.lit(5).alias("_b"))
    wanted = spark.createDataFrame([(5, "m", 12_345, 0, 20_000, 1000.0, 1000.019999)], "_b int, _name string, _rank long, _before long, _n long, _low double, _high double")
    rows = Q._inside(counts, Q._narrower(counts, Q._narrower(counts, wanted, []), []), []).collect()
    assert len(rows) <= 20_000 / parts**2 + 2
    assert rows[0]["_before"] < 12_345 <= rows[0]["_before"] + len(rows)
