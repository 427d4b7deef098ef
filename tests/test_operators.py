"""Operators on small fixtures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import causal as C
from tallyspark.operators import holdout as HO
from tallyspark.operators import outcomes as O
from tallyspark.operators import survival as SV
from tallyspark.operators.ledger import spend_by_day, spend_by_model, spend_by_session
from tallyspark.operators.pricing import derive_rate_card, find_rates, price_requests
from tallyspark.session import materialise

DAY = 86_400_000


def requests(spark, rows):
    full = [(f"r{i}", s, t, m, p, 10, c, i, "w/chatSessions/a", 0) for i, (s, t, m, p, c) in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "request_id string, session_id string, ts long, model string, prompt_tokens long, output_tokens long, "
        "credits double, turn_index long, source_file string, source_offset long",
    )


def test_money_is_conserved_and_kinds_stay_apart(spark):
    rng = random.Random(1)
    rows = [
        (f"s{rng.randrange(5)}", rng.randrange(40) * DAY, rng.choice(["a", "b", "never"]), rng.randrange(1, 9000),
         rng.choice([None, 5.0, 9.5]))
        for _ in range(200)
    ]
    rows = [(s, t, m, p, None if m == "never" else c) for s, t, m, p, c in rows]
    req = requests(spark, rows)
    card = derive_rate_card(req)
    rates = {r["model"]: r for r in card.collect()}
    assert rates["never"]["provenance"] == "modelled" and rates["never"]["sample_size"] == 0
    whole = price_requests(req, materialise(card)).agg(F.sum("price")).first()[0]
    for view in (spend_by_day, spend_by_model, spend_by_session):
        got = view(req, card).agg(F.sum("credits"), F.sum("measured_credits"), F.sum("modelled_credits")).first()
        assert got[0] == pytest.approx(whole)
        assert got[1] + got[2] == pytest.approx(got[0])
        assert got[1] == pytest.approx(sum(c for *_, c in rows if c))


def test_dated_release_needs_to_be_unique(spark):
    card = derive_rate_card(requests(spark, [
        ("s", 1, "gpt-x-2024-01-01", 1000, 2.0), ("s", 2, "solo-20240101", 1000, 3.0),
        ("s", 3, "gpt-x-20250101", 1000, 4.0), ("s", 4, "Big.Model", 1000, 5.0)]))
    wanted = spark.createDataFrame([("gpt-x",), ("solo",), ("big_model",), ("none",)], "model string")
    rates = {r["model"]: r["rate"] for r in find_rates(wanted, card).collect()}
    assert rates == {"gpt-x": None, "solo": 3.0, "big_model": 5.0, "none": None}


def brute_force_durability(files, horizon):
    stacks, matches = {}, {}
    for path, sha, ts, added, deleted in sorted(files, key=lambda f: (f[2], f[1])):
        stack = stacks.setdefault(path, [])
        for cohort in reversed(stack):
            if deleted <= 0:
                break
            if cohort[2] <= 0:
                continue
            if ts - cohort[1] > horizon:
                break
            eaten = min(cohort[2], deleted)
            cohort[2] -= eaten
            deleted -= eaten
            key = (path, cohort[0], ts)
            matches[key] = matches.get(key, 0) + eaten
        if added > 0:
            stack.append([sha, ts, added])
    return matches


def test_deletions_eat_the_newest_lines(spark):
    rng = random.Random(5)
    files = []
    for i in range(400):
        ts = rng.randrange(0, 200 * 24) * 3_600_000
        files.append((f"p{rng.randrange(3)}", f"c{i:04d}", ts, rng.randrange(0, 12), rng.randrange(0, 12)))
    df = spark.createDataFrame(files, "path_hash string, sha string, ts long, added long, deleted long")
    got = O.attribute_deletions(df).groupBy("path_hash", "change_id", "deleted_ts").agg(F.sum("lines").alias("n"))
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == brute_force_durability(files, 30 * DAY)


def test_groups_without_a_match_stay_out_of_python(spark, monkeypatch):
    """Deletions of a commit come before its additions, so single commits and earlier deletions have nothing to match."""

    def refuse(keys):
        def match(batches):
            for batch in batches:
                assert batch.empty
                yield batch

        return match

    monkeypatch.setattr(O, "_newest_first", refuse)
    files = [("p", "c1", 0, 5, 3), ("q", "c1", 0, 0, 4), ("q", "c2", DAY, 6, 0), ("r", "c3", 2 * DAY, 7, 7)]
    df = spark.createDataFrame(files, "path_hash string, sha string, ts long, added long, deleted long")
    assert O.attribute_deletions(df).count() == 0


def test_curve_reaches_zero_without_error(spark):
    rows = [(1.0, True, 1.0), (2.0, False, 1.0), (3.0, True, 2.0), (-1.0, True, 5.0), (4.0, True, 0.0)]
    curve = SV.kaplan_meier(spark.createDataFrame(rows, "duration double, event boolean, weight double"))
    got = {r["time"]: r for r in curve.collect()}
    assert got[1.0]["survival"] == pytest.approx(0.75) and got[1.0]["standard_error"] == pytest.approx(0.2165, abs=1e-4)
    assert got[3.0]["survival"] == 0 and got[3.0]["standard_error"] == 0
    assert set(got) == {1.0, 2.0, 3.0}


def panel(spark, effect, units=5, periods=12):
    rows, cohorts = [], []
    for c, start in enumerate([4, 6, 8, None]):
        for u in range(units):
            cohorts.append((f"u{c}-{u}", start))
            for t in range(periods):
                treated = start is not None and t >= start
                rows.append((f"u{c}-{u}", t, 10 + 0.5 * t + u + (effect if treated else 0.0) + ((u * 7 + t * 3) % 5) * 0.01))
    return (spark.createDataFrame(rows, "unit string, period long, outcome double"),
            spark.createDataFrame(cohorts, "unit string, treated_at long"))


@pytest.mark.parametrize("effect", [0.0, 2.0])
def test_planted_effect_is_recovered(spark, effect):
    rows, cohorts = panel(spark, effect)
    effects = C.group_time_effects(rows, cohorts, draws=200)
    att = C.average_effect(effects).first()
    assert att["effect"] == pytest.approx(effect, abs=0.05)
    assert att["low"] - 0.05 <= effect <= att["high"] + 0.05
    again = C.average_effect(C.group_time_effects(rows, cohorts, draws=200)).first()
    assert again["low"] == pytest.approx(att["low"]) and again["high"] == pytest.approx(att["high"])


def test_benjamini_hochberg_textbook(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([(f"h{i}", p) for i, p in enumerate(ps)], "key string, p_value double")
    got = {r["key"]: r for r in C.benjamini_hochberg(df).collect()}
    assert [got[f"h{i}"]["rejected"] for i in range(8)] == [True, True] + [False] * 6
    assert got["h0"]["q_value"] == pytest.approx(0.008) and got["h2"]["q_value"] == pytest.approx(0.0672)


@pytest.mark.parametrize("n,dimensions", [(5, "none"), (40, "spend"), (400, "team+spend")])
def test_holdout_quotas_are_exact_and_reproducible(spark, n, dimensions):
    units = [(f"u{i:03d}", f"team-{i % 4}", float(round(50 * 2.718 ** ((i % 17) / 3)))) for i in range(n)]
    df = spark.createDataFrame(units, "unit string, team string, pre_spend double")
    rows = HO.assign_holdout(df, 9).collect()
    assert len({r["unit"] for r in rows}) == n and {r["dimensions"] for r in rows} == {dimensions}
    assert sum(r["arm"] == "holdout" for r in rows) == int(n * 0.15 + 0.5)
    same = HO.assign_holdout(df.repartition(5), 9).collect()
    assert {(r["unit"], r["arm"]) for r in rows} == {(r["unit"], r["arm"]) for r in same}


def test_minimum_detectable_effect(spark):
    df = spark.createDataFrame([(1.0, 10.0, 50, 50)], "sd double, baseline double, treated long, holdout long")
    row = HO.assess_power(df).first()
    assert row["mde"] == pytest.approx((1.959964 + 0.841621) * (2 / 50) ** 0.5, abs=1e-5)
