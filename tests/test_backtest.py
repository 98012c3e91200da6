from __future__ import annotations

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from siembra.operators import backtest as B
from siembra.operators import forecast as FC
from siembra.operators import least_squares as LS
from siembra.operators import panel as P
from siembra.operators.metrics import error_metrics, holdout, periods_of
from siembra.plans import backtests as BT
from siembra.sources.scratch import written
from tests.conftest import DATA

COLUMNS = ["lag_1", "lag_12", "rolling_mean_3", "rolling_max_12", "month_sin", "month_cos", "year", "quarter", "month"]


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(4)
    months = [date(2020 + k // 12, k % 12 + 1, 1) for k in range(40)]
    rows = [(f"p{i}", m, float(max(0, round(20 * i + 15 * math.sin(k / 2) + rng.gauss(0, 9))))) for i in range(7) for k, m in enumerate(months) if rng.random() < 0.9]
    panel = spark.createDataFrame(rows, "product_id string, periodo date, target_qty double")
    return written(FC.prepared(P.complete_grid(panel)), "features")


def separate_fit(x, y, penalty):
    """Standardised least squares of the rows themselves."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-9, 1, std)
    z = (x - mean) / std
    b = np.linalg.lstsq(np.r_[z, np.sqrt(penalty) * np.eye(z.shape[1])], np.r_[y - y.mean(), np.zeros(z.shape[1])], rcond=1e-9)[0]
    return lambda new: (new - mean) / std @ b + y.mean()


def capped(raw, r):
    most = 3 * max(0.0, r["expanding_max"], r["rolling_max_12"], r["rolling_mean_12"])
    p = max(0.0, math.expm1(min(raw, 50)))
    return min(p, most) if most > 0 else p


@pytest.mark.parametrize("name", list(B.PENALTIES))
def test_windows_equal_separate_fits(features, name):
    rows = features.collect()
    train = FC.trainable(features).collect()
    got = {(r["fold_id"], r["product_id"], r["periodo"]): r["prediccion"] for r in B.walk_forward_backtest(features, COLUMNS).where(F.col("model_name") == name).collect()}
    cuts = B.folds(periods_of(features))
    assert [c["fold_id"] for c in cuts] == [1, 2, 3, 4, 5, 6] and cuts[-1]["test_until"] == max(r["periodo"] for r in rows)
    want = {}
    for cut in cuts:
        past = [r for r in train if r["periodo"] < cut["test_from"]]
        model = separate_fit(np.array([[r[c] for c in COLUMNS] for r in past], float), np.log1p([r["target_qty"] for r in past]), B.PENALTIES[name])
        for r in rows:
            if cut["test_from"] <= r["periodo"] <= cut["test_until"]:
                want[cut["fold_id"], r["product_id"], r["periodo"]] = capped(model(np.array([r[c] for c in COLUMNS], float)), r)
    assert got.keys() == want.keys() and len(got) >= 6 * 3 * 6
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


def test_sums_merge_whatever_the_partitions(features):
    target = F.log1p("target_qty")
    one = LS.monthly_moments(features.coalesce(1), COLUMNS, target)
    many = LS.monthly_moments(features.repartition(7), COLUMNS, target)
    assert one.keys() == many.keys()
    assert all(np.allclose(one[m].sums, many[m].sums) for m in one)
    with pytest.raises(ValueError, match="no rows"):
        LS.Moments(("a",), np.zeros(2), np.zeros((3, 3))).solve()


def test_learning_curve(features):
    curve = B.learning_curve(features, COLUMNS).orderBy("curve_point").collect()
    split = holdout(periods_of(features))
    assert len(curve) == 8 and curve[-1]["train_until"] == split["train"][-1] and curve[-1]["train_periods"] == len(split["train"])
    train = FC.trainable(features).collect()
    for r in (curve[0], curve[4], curve[-1]):
        past = [t for t in train if t["periodo"] <= r["train_until"]]
        model = separate_fit(np.array([[t[c] for c in COLUMNS] for t in past], float), np.log1p([t["target_qty"] for t in past]), 1.0)
        for part, rows in (("train", past), ("validation", [t for t in features.collect() if t["periodo"] in split["validation"]])):
            p = [capped(model(np.array([t[c] for c in COLUMNS], float)), t) for t in rows]
            wape = sum(abs(a - t["target_qty"]) for a, t in zip(p, rows, strict=True)) / sum(t["target_qty"] for t in rows)
            assert r[f"wape_{part}"] == pytest.approx(wape, rel=1e-5)
        assert r["train_rows"] == len(past) and r["wape_gap"] == pytest.approx(r["wape_validation"] - r["wape_train"])


def test_segments(spark):
    rows = [(1, "m", "a", 50.0, "activo", True), (1, "m", "b", 30.0, "activo", False), (1, "m", "c", 15.0, "inactivo", None), (1, "m", "d", 5.0, "activo", False), (2, "m", "a", 0.0, "activo", False)]
    df = spark.createDataFrame([(f, m, p, y, s, e, y) for f, m, p, y, s, e in rows], "fold_id int, model_name string, product_id string, target_qty double, estado_producto string, es_estacional boolean, prediccion double")
    got = {}
    for r in B.with_segments(df).collect():
        got.setdefault((r["fold_id"], r["segmento"]), set()).add(r["product_id"])
    assert got[1, "top_50pct_volumen"] == {"a"} and (1, "top_20pct_volumen") not in got
    assert got[1, "todos"] == set("abcd") and got[1, "activos_estacionales"] == {"a"} and got[1, "no_estacionales"] == set("bcd") and got[1, "inactivos"] == {"c"}
    assert got[2, "top_20pct_volumen"] == {"a"}


def test_seasonal_segments_are_reviewed(spark):
    rows = [("m", k, s, 0.05, 1.0, 1.0, 10) for k in range(4) for s in ("todos", "estacionales")]
    got = {r["segmento"]: r for r in B.stability(spark.createDataFrame(rows, "model_name string, fold_id int, segmento string, wape double, mae double, rmse double, n long")).collect()}
    assert got["todos"]["segmento_apto_automatizacion"] and not got["estacionales"]["segmento_apto_automatizacion"]
    assert got["todos"]["rows_total"] == 40 and got["todos"]["std_wape"] == 0.0


def test_baselines_alone_equal_those_of_the_whole_backtest(spark, features):
    """Only lag_1 and lag_12 are read, and nothing is fitted."""
    slim = features.select("product_id", "periodo", "target_qty", "lag_1", "lag_12")
    rows = lambda df: sorted(tuple(r) for r in df.where(F.col("model_name").isin(*B.BASELINES)).select("product_id", "periodo", "model_name", "fold_id", "prediccion").collect())
    assert rows(B.baseline_backtest(slim)) == rows(B.walk_forward_backtest(features, ["lag_1"])) != []
    made = BT.features(spark, str(DATA), "product_id", *slim.columns)
    assert made.columns == slim.columns and made.count() > 0


def test_errors_by_sets_of_segments(spark):
    """Sums by set of segments give each segment's errors; with models that predict the same rows shares are taken once a fold."""
    rng = random.Random(3)
    truth = [(f, f"p{k}", float(rng.randrange(0, 9)), rng.choice(["activo", "inactivo"]), rng.choice([True, False, None])) for f in (1, 2) for k in range(30) for _ in range(3)]
    rows = [(f, m, p, y, max(y + rng.choice([-2.0, 0.0, 1.5]), 0.0), s, e) for f, p, y, s, e in truth for m in ("a", "b")]
    df = spark.createDataFrame(rows, "fold_id int, model_name string, product_id string, target_qty double, prediccion double, estado_producto string, es_estacional boolean")
    keys = ["model_name", "fold_id", "segmento"]
    want = {tuple(r[:3]): r[3:] for r in B.with_segments(df).groupBy(*keys).agg(*error_metrics("target_qty", "prediccion")).collect()}
    for by in (["fold_id", "model_name"], ["fold_id"]):
        got = B.fold_errors(df, by)
        assert {tuple(r[:3]): pytest.approx(r[3:]) for r in got.collect()} == want
        assert got.columns == [*keys, "mae", "rmse", "smape", "wape", "bias_pct", "n"]
    plan = B.fold_errors(df, ["fold_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # segments are spread after rows are added up
