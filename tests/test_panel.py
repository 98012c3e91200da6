from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from siembra.operators import panel as P


def months(n, year=2025, month=1):
    out = []
    for k in range(n):
        m = month - 1 + k
        out.append(date(year + m // 12, m % 12 + 1, 1))
    return out


def panel(spark, quantities, start=(2025, 1), key="P"):
    return spark.createDataFrame([(key, d, float(q)) for d, q in zip(months(len(quantities), *start), quantities, strict=True)], "product_id string, periodo date, target_qty double")


def test_state_sees_only_earlier_months(spark):
    df = P.point_in_time_profile(panel(spark, [10, 0, 0, 0, 8, 0]), inactive_months=2)
    rows = {r["periodo"].month: r for r in df.collect()}
    assert (rows[4]["ultima_actividad"], rows[4]["estado_producto"]) == (date(2025, 1, 1), "inactivo")
    assert (rows[6]["ultima_actividad"], rows[6]["estado_producto"]) == (date(2025, 5, 1), "activo")
    assert rows[1]["ultima_actividad"] is None


def test_seasonality_needs_two_years(spark):
    q = [0] * 25
    q[11] = q[23] = 100
    rows = {r["periodo"]: r for r in P.point_in_time_profile(panel(spark, q, (2024, 1))).collect()}
    june, january = rows[date(2025, 6, 1)], rows[date(2026, 1, 1)]
    assert (june["es_estacional"], june["share_top_3_meses"]) == (False, 1.0)
    assert january["es_estacional"]
    assert january["meses_estacionales_num"] == "12"
    assert january["meses_estacionales"] == "diciembre"


def test_grid_fills_gaps_and_skips_the_never_active(spark):
    df = panel(spark, [0, 5, 0]).where("target_qty > 0 or month(periodo) = 1").unionByName(panel(spark, [0, 0, 0, 0], key="N"))
    g = P.complete_grid(df).orderBy("periodo").collect()
    assert [(r["product_id"], r["periodo"].month, r["target_qty"], r["monthly_observed_flag"]) for r in g] == [("P", 2, 5.0, 1), ("P", 3, 0.0, 0), ("P", 4, 0.0, 0)]


def test_lags_stay_inside_a_product(spark):
    df = P.lag_features(panel(spark, [1, 2, 3, 4]).unionByName(panel(spark, [9, 9, 9], key="Q")))
    rows = df.where("product_id = 'Q'").orderBy("periodo").collect()
    assert rows[0]["lag_1"] is None
    assert rows[0]["rolling_mean_3"] is None
    assert rows[0]["nonzero_6"] == 0
    assert rows[2]["rolling_mean_3"] == 9.0
    assert rows[2]["rolling_std_3"] == 0.0


def test_name_versions(spark):
    rows = [("1", date(2024, 1, 1), "A"), ("1", date(2024, 1, 1), "B"), ("1", date(2024, 2, 1), "B"), ("1", date(2024, 3, 1), "A"), ("1", date(2024, 4, 1), "")]
    got = P.name_versions(spark.createDataFrame(rows, "c string, m date, n string"), "c", "m", "n").orderBy("version").collect()
    assert [(r["sku_id"], r["n"], r["vigente_desde"].month, r["activo"]) for r in got] == [("1_V1", "A", 1, False), ("1_V2", "B", 2, False), ("1_V3", "A", 3, True)]


def test_imputation(spark):
    df = panel(spark, [0, 0, 0]).withColumn("v", F.when(F.month("periodo") == 2, 7.0))
    assert [(r["v"], r["imputacion"]) for r in P.impute(df, "product_id", "periodo", "v").orderBy("periodo").collect()] == [(7.0, "posterior"), (7.0, "observado"), (7.0, "previo")]


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_panels(spark, n):
    df = panel(spark, [3.0] * n)
    assert P.feature_matrix(P.complete_grid(df)).count() == n
    assert P.product_summary(df).count() == n
