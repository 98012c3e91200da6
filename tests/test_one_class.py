"""The fitted machine is the minimum of its objective, finds a planted row and keeps the share outside."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siembra.operators import one_class as OC


def frame(spark, x):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id int, a double, b double").repartition(3)


def objective(model, x, weight, rho, nu, tau):
    z = [[math.sqrt(2 / len(model.phase)) * math.cos(sum(f * (v - m) / s for f, v, m, s in zip(fr, row, model.mean, model.spread)) + ph) for fr, ph in zip(model.frequency, model.phase)] for row in x]
    loss = sum(tau * np.logaddexp(0, (rho - sum(w * c for w, c in zip(weight, row))) / tau) for row in z)
    return sum(w * w for w in weight) / 2 - rho + loss / (nu * len(x))


def test_no_step_away_lowers_the_objective(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    model = OC.fit(frame(spark, x), ["a", "b"], nu=0.2, width=12)
    least = objective(model, x, model.weight, model.rho, 0.2, OC.SOFTNESS[-1])
    for _ in range(20):
        away = rng.normal(size=13)
        away *= 0.02 / np.linalg.norm(away)
        assert objective(model, x, model.weight + away[:-1], model.rho + away[-1], 0.2, OC.SOFTNESS[-1]) > least
    slope = 1 / (1 + np.exp(model.decision(x) / OC.SOFTNESS[-1]))
    assert slope.mean() == pytest.approx(0.2, abs=1e-3)


def test_features_stand_for_the_kernel():
    rng = np.random.default_rng(2)
    wide = OC.OneClass(np.zeros(2), np.ones(2), rng.normal(0, 1, (20000, 2)), rng.uniform(0, 2 * np.pi, 20000), np.zeros(1), 0.0)
    x = rng.normal(size=(6, 2))
    z = wide.features(x)
    assert np.allclose(z @ z.T, np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1)), atol=0.04)


def test_a_planted_row_ranks_first_and_the_share_is_exact(spark):
    rng = np.random.default_rng(3)
    ring = rng.uniform(0, 2 * np.pi, 299)
    x = np.r_[np.c_[np.cos(ring), np.sin(ring)] + rng.normal(0, 0.05, (299, 2)), [[6.0, -6.0]]]
    model = OC.fit(frame(spark, x), ["a", "b"], nu=0.1)
    out = OC.scored(frame(spark, x), model, ["a", "b"], 0.1).orderBy(F.desc("score")).collect()
    assert out[0].id == 299 and sum(r.es_anomalia for r in out) == 30 and all(r.es_anomalia for r in out[:30])
    other = OC.scored(frame(spark, x).repartition(7), OC.fit(frame(spark, x).repartition(1), ["a", "b"], nu=0.1), ["a", "b"], 0.1)
    assert {r.id for r in other.where("es_anomalia").collect()} == {r.id for r in out[:30]}


def test_missing_values_and_tables_without_spread(spark):
    x = np.random.default_rng(4).normal(size=(40, 2))
    holes = frame(spark, x).withColumns({"a": F.when(F.col("id") == 3, None).when(F.col("id") == 4, float("nan")).when(F.col("id") == 5, float("inf")).otherwise(F.col("a"))})
    filled = frame(spark, x).withColumn("a", F.when(F.col("id").isin(3, 4, 5), 0.0).otherwise(F.col("a")))
    score = lambda df: {r.id: r.score for r in OC.scored(df, OC.fit(df, ["a", "b"]), ["a", "b"]).collect()}
    assert score(holes) == pytest.approx(score(filled), abs=1e-6)
    for df in (frame(spark, x).limit(0), frame(spark, x).limit(1), frame(spark, np.full((5, 2), 0.1))):
        out = OC.scored(df, OC.fit(df, ["a", "b"]), ["a", "b"]).collect()
        assert all(r.score == 0 and r.es_anomalia is False for r in out)
    with pytest.raises(ValueError):
        OC.fit(frame(spark, x), ["a", "b"], nu=0)
