from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.operators import decision as DC
from siembra.operators import inventory as I
from siembra.operators import match as MT
from siembra.operators import metrics as ME
from siembra.operators import mining as M
from siembra.operators import relational as R


def test_keep_best_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2), (None, 5)], "k string, v int")
    assert {(r["k"], r["v"]) for r in R.keep_best(df, ["k"], F.desc("v")).collect()} == {("a", 3), (None, 5)}
    with pytest.raises(ValueError, match="duplicate key"):
        R.assert_unique(df, ["k"])
    with pytest.raises(ValueError, match="null values"):
        R.require(df, "k")


def test_conform_adds_and_coerces(spark):
    shape = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = R.conform(spark.createDataFrame([(2.5, 1), (float("nan"), 2)], "a double, z int"), shape).collect()
    assert [tuple(r) for r in got] == [(2, None), (None, None)]


def test_average_rank(spark):
    df = spark.createDataFrame([(10.0,), (10.0,), (5.0,), (1.0,)], "x double")
    assert sorted(r[0] for r in df.select(R.average_rank(F.col("x")) / 4).collect()) == [0.375, 0.375, 0.75, 1.0]


def decided(spark):
    p = [("A", "activo", False), ("B", "activo", True), ("C", "inactivo", False), ("D", "activo", False)]
    p = spark.createDataFrame([(i, date(2026, 1, 1), 100.0, s, e) for i, s, e in p], "product_id string, periodo date, cantidad_predicha double, estado_producto string, es_estacional boolean")
    segments = spark.createDataFrame([("activos_no_estacionales", True, 0.06, 0.01, 1.0), ("activos_estacionales", False, 0.11, 0.04, 0.5), ("inactivos", False, 0.2, 0.0, 0.0)], "segmento string, segmento_apto_automatizacion boolean, mean_wape double, std_wape double, pct_folds_below_wape_threshold double")
    errors = spark.createDataFrame([("D", 999.0, 0.2, "alta")], "product_id string, error_absoluto_total double, wape_producto double, prioridad_revision string")
    return DC.decide(p, segments, errors, 0.05)


def test_decision_rules(spark):
    rows = {r["product_id"]: r for r in decided(spark).collect()}
    assert (rows["A"]["confianza_prediccion"], rows["A"]["recomendacion_decision"], rows["A"]["apto_automatizacion"]) == ("alta", "usar como cantidad sugerida", True)
    assert (rows["B"]["confianza_prediccion"], rows["B"]["recomendacion_decision"]) == ("media", "revisar antes de ordenar")
    assert (rows["C"]["confianza_prediccion"], rows["C"]["recomendacion_decision"]) == ("no_aplica", "no producir por inactividad")
    assert (rows["D"]["confianza_prediccion"], rows["D"]["requiere_revision"]) == ("baja", True)
    assert all(r["prediccion_min"] <= r["cantidad_predicha"] <= r["prediccion_max"] for r in rows.values())
    assert [r["product_id"] for r in DC.review_list(decided(spark)).collect()] == ["D", "B"]


def test_high_error_dedupe(spark):
    df = spark.createDataFrame([("D", 100.0, 10.0, 0.1, "normal"), ("D", 200.0, 20.0, 0.1, "alta")], "product_id string, cantidad_real_total double, error_absoluto_total double, wape_producto double, prioridad_revision string")
    (row,) = ME.dedupe_high_error(df).collect()
    assert (row["prioridad_revision"], row["error_absoluto_total"], round(row["wape_producto"], 9)) == ("alta", 30.0, 0.1)


def test_folds_never_overlap_the_future():
    months = [date(2024 + k // 12, k % 12 + 1, 1) for k in range(22)]
    for train, test in [*ME.rolling_origin(months), *ME.walk_forward(months)]:
        assert max(train) < min(test)
    split = ME.holdout(months)
    assert max(split["train"]) < min(split["validation"]) <= max(split["validation"]) < min(split["test"])
    with pytest.raises(ValueError, match="test months"):
        ME.best_model({"a": 1.0, "b": 0.5}, "test")
    assert ME.best_model({"a": 1.0, "b": 0.5}, "validation") == "b"


def test_psi(spark):
    df = spark.range(100).selectExpr("cast(id as double) as x")
    assert abs(ME.psi(df, df, "x")) < 1e-9
    assert ME.psi(df, df.selectExpr("x + 80 as x"), "x") > 1
    assert ME.psi(df.selectExpr("1.0D as x"), df, "x") == 0.0


def test_stock_identity(spark):
    rows = [("A", date(2026, m, 1), 10.0 * m, 25.0, 5.0, 40.0, True) for m in (1, 2, 3)] + [("B", date(2026, 1, 1), 10.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "product_id string, periodo date, cantidad_predicha double, stock_actual double, stock_minimo double, stock_maximo double, stock_encontrado boolean")
    got = {(r["product_id"], r["periodo"].month): r for r in I.project_stock(df).collect()}
    stock = 25.0
    for m in (1, 2, 3):
        r = got["A", m]
        made = min(max(10.0 * m + 5 - stock, 0), max(40 - stock, 0))
        assert (r["stock_proyectado_inicio"], r["cantidad_a_producir_ajustada"]) == (stock, made)
        stock = stock + made - 10.0 * m
        assert r["stock_proyectado_fin"] == stock
    assert got["B", 1]["alerta_inventario"] == "sin_stock_actual"


def test_rules_and_holdout(spark):
    baskets = [(k, i) for k in range(10) for i in (["pan", "leche"] if k < 8 else ["pan", "sal"])]
    pairs = M.baskets(spark.createDataFrame([*baskets, (99, "solo"), (None, "x"), (3, "nan")], "b int, i string"), "b", "i")
    rules = M.association_rules(M.pair_counts(pairs, "b", "i"), 0.02, 0.25)
    got = {(r["antecedent"], r["consequent"]): (r["support"], r["confidence"]) for r in rules.collect()}
    assert got == {("leche", "pan"): (0.8, 1.0), ("sal", "pan"): (0.2, 1.0)}
    real = {r["antecedent"]: r["confidence_real"] for r in M.realised(rules, pairs, "b", "i").collect()}
    assert real == {"leche": 1.0, "sal": 1.0}


def test_isolation_forest_ranks_the_outlier_first(spark):
    df = spark.createDataFrame([(k, float(k % 5), float(k % 3)) for k in range(40)] + [(99, 500.0, 900.0)], "id int, x double, y double")
    top = M.isolation_forest(df, ["x", "y"]).orderBy(F.desc("anomaly_score")).first()
    assert (top["id"], top["es_anomalia"]) == (99, True)
    assert M.local_outlier_factor(df, "id", ["x", "y"]).orderBy(F.desc("lof")).first()["id"] == 99


def test_cascade(spark):
    cat = spark.createDataFrame([(1, "ALINO COMPLETO FUNDA 90 G"), (2, "SALSA CHINA BOTELLA 300 ML"), (3, "COMINO MOLIDO FRASCO 50 G (4488)")], "catalog_id int, product_name string")
    names = spark.createDataFrame([("aliño comp fda 90grs",), ("BOTELLA SALSA CHINA 300ML",), ("COMINO X (4488)",), ("SALSA CHYNA BOT 300 ML",), ("NADA QUE VER",)], "producto string")
    got = {r["producto"]: (r["catalog_id"], r["match_status"]) for r in MT.cascade(names, cat).collect()}
    assert got["aliño comp fda 90grs"] == (1, "exact")
    assert got["BOTELLA SALSA CHINA 300ML"] == (2, "signature")
    assert got["COMINO X (4488)"] == (3, "code")
    assert got["SALSA CHYNA BOT 300 ML"][0] == 2
    assert got["NADA QUE VER"] == (None, "sin_match")
