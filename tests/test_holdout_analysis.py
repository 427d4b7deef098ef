"""The composed holdout analysis on planted experiments."""

import random

from tallyspark.operators.holdout import DAY_MS, analyse_holdout, assign_holdout

DEPLOYED = 20 * 7 * DAY_MS


def experiment(spark, effect, seed=3, units=60):
    rng = random.Random(seed)
    roster = spark.createDataFrame([(f"u{i}", "t", float(i % 7)) for i in range(units)], "unit string, team string, pre_spend double")
    arms = assign_holdout(roster, 7, 0.4)
    treated = {r["unit"] for r in arms.where("arm = 'treated'").collect()}
    changes = [
        (f"u{i}", (16 + p) * 7 * DAY_MS + i, True, 0.5 + rng.gauss(0, 0.02) + effect * (p >= 4 and f"u{i}" in treated))
        for i in range(units)
        for p in range(8)
    ]
    changes += [("nobody", DEPLOYED, True, 0.5), ("u0", DEPLOYED, False, 9.0)]
    return arms, spark.createDataFrame(changes, "author_id string, ts long, fully_observed boolean, surviving_fraction double")


def levels(spark, rows=(("cycle-time", 10.0, 10.5, 100),)):
    return spark.createDataFrame(list(rows), "metric string, baseline double, current double, observations long")


def told(analysis):
    return {(r["section"], r["subject"], r["figure"]): r["label"] if r["number"] is None else r["number"] for r in analysis.report().collect()}


def test_planted_effect(spark):
    effect = 0.2
    arms, changes = experiment(spark, effect)
    found = told(analyse_holdout(arms, changes, levels(spark), DEPLOYED, draws=200))
    assert found["verdict", "", "verdict"] == "effect-detected"
    assert abs(found["primary", "", "effect"] - effect) < 0.02
    assert found["primary", "", "low"] <= found["primary", "", "effect"] <= found["primary", "", "high"]
    assert found["power", "", "treated"] + found["power", "", "holdout"] == 60
    assert found["summary", "", "control_units"] == found["power", "", "holdout"] + 1


def test_what_voids_an_effect(spark):
    arms, changes = experiment(spark, 0.2)
    late = told(analyse_holdout(arms, changes, levels(spark), None, draws=20))
    assert late["verdict", "", "verdict"] == "no-estimate" and late["primary", "", "effect"] is None
    bare = told(analyse_holdout(arms, changes.limit(0), levels(spark), DEPLOYED, draws=20))
    assert bare["verdict", "", "verdict"] == "no-estimate" and bare["power", "", "mde"] is None
    breach = levels(spark, [("cycle-time", 10.0, 15.0, 100)])
    loose = told(analyse_holdout(arms, changes, breach, DEPLOYED, registered=False, draws=20))
    assert loose["verdict", "", "verdict"] == "exploratory" and loose["verdict", "", "breaches"] == 1
    assert loose["registration", "", "status"] == "unregistered"
