from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siembra.operators import silver as S
from siembra.plans import gold


def test_pareto_keeps_negative_totals(spark, monkeypatch):
    sold = spark.createDataFrame([(1, 100.0), (2, -30.0), (3, 10.0), (4, 0.0), (5, -0.5), (6, -30.0)], "product_id long, value double")
    monkeypatch.setattr(gold, "sales", lambda *_: sold)
    got = {r["product_id"]: round(r["pct_acumulado"], 6) for r in gold.pareto(spark, "").collect()}
    whole, run, want = 49.5, 0.0, {}
    for key, total in [(1, 100.0), (3, 10.0), (4, 0.0), (5, -0.5), (2, -30.0), (6, -30.0)]:
        run += total
        want[key] = round(run / whole * 100, 6)
    assert got == want


def test_signs_and_nulls(spark):
    df = spark.createDataFrame([(1, -2.0, 5.0), (2, 2.0, -5.0), (3, 2.0, 5.0), (4, None, None)], "k long, q double, v double")
    got = {r["k"]: (r["cant_venta"], r["total_venta"], r["cant_devolucion"], r["total_devolucion"]) for r in S.route_signs(df, "q", "v").collect()}
    assert got == {1: (0, 0, 2, 5), 2: (0, 0, 2, 5), 3: (2, 5, 0, 0), 4: (0, 0, 0, 0)}


def test_issues():
    summary = {"pt_mensual_model": {"rows": 2, "products": 1}, "pp_mensual_model": {"rows": 0}}
    rules = {"pt_mensual_model": {"rows": 100}, "pp_mensual_model": {"rows": 1}, "pt_productos_model": {"rows": 1}}
    assert [x.split(":")[0] for x in S.input_issues(summary, rules)] == ["pt_mensual_model", "pp_mensual_model", "pt_productos_model"]
    assert S.input_issues({"a": {"rows": 5, "products": 2}}, {"a": {"rows": 5, "products": 2}}) == []


@pytest.mark.parametrize(("rate", "label"), [(100.0, "CUMPLE"), (95.0, "CUMPLE"), (80.0, "PARCIAL"), (10.0, "BAJO"), (0.0, "SIN_DESPACHO")])
def test_dispatch(spark, rate, label):
    assert spark.range(1).select(S.dispatch_class(F.lit(rate)).alias("x")).first()["x"] == label


def test_exogenous_values_are_means_over_source_and_general_rows(spark):
    panel = spark.sql("SELECT * FROM VALUES ('a', DATE'2025-01-01'), ('b', DATE'2025-02-01') t(product_id, periodo)")
    calendar = spark.sql("SELECT * FROM VALUES ('ALL', DATE'2025-01-01', 10), ('pt', DATE'2025-01-01', 20), ('PP', DATE'2025-01-01', 3) t(source_type, periodo, dias)")
    product = spark.sql("SELECT * FROM VALUES ('PT', 'a', DATE'2025-01-01', 1), (NULL, 'a', DATE'2025-01-01', 3), ('PP', 'a', DATE'2025-01-01', 9) t(source_type, product_id, periodo, x)")
    got = {r["product_id"]: (r["dias"], r["x"]) for r in S.exogenous(panel, calendar, product, "PT").collect()}
    assert got == {"a": (15.0, 2.0), "b": (0.0, 0.0)}


def test_flags_that_were_set_stay(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0, 6.0, True), (2, 10.0, 4.0, None, False), (3, 10.0, 4.0, 6.0, None), (4, 10.0, 4.0, 1e13, True)], "k int, total_neto double, costo_venta double, rentabilidad double, flag_outlier boolean")
    assert {r["k"]: (r["rentabilidad"], r["flag_outlier"]) for r in S.repair_margin(df).collect()} == {1: (6.0, True), 2: (6.0, True), 3: (6.0, False), 4: (6.0, True)}
    assert [r["flag_outlier"] for r in S.repair_margin(df.drop("flag_outlier")).orderBy("k").collect()] == [False, True, False, True]


def test_suspicious_extremes(spark):
    rows = [("a", k, 10.0 + k % 3, 5.0, 4) for k in range(30)] + [("a", 30, 500.0, 0.0, 1), ("b", 0, None, 1.0, 1)]
    got = {(r["p"], r["m"]): r for r in S.cap_suspicious(spark.createDataFrame(rows, "p string, m int, hecha double, plan double, ordenes int"), ["p"], "hecha", "plan", "ordenes").collect()}
    peak = got["a", 30]
    assert peak["sospechoso_hecha"] and peak["tratamiento"] == "cap_hecha" and peak["hecha_raw"] == 500.0 and 12.0 < peak["hecha"] < 500.0
    assert sum(r["sospechoso_hecha"] for r in got.values()) == 1 and got["b", 0]["hecha"] == 0.0
    backed = [(p, m, q, 1.0 if q == 500 else n, o) for p, m, q, n, o in rows]
    kept = [r for r in S.cap_suspicious(spark.createDataFrame(backed, "p string, m int, hecha double, plan double, ordenes int"), ["p"], "hecha", "plan", "ordenes").collect() if r["m"] == 30]
    assert kept[0]["extremo_hecha"] and not kept[0]["sospechoso_hecha"] and kept[0]["hecha"] == 500.0


def test_finished_products_add_safety_and_take_off_stock(spark):
    df = spark.createDataFrame([("PT", 100.0, 50.0, 40.0, None), ("PP", 100.0, 50.0, 40.0, None)], "t string, q double, l double, s double, f double")
    got = {r["t"]: (r["qty_recomendada"], r["qty_min_recomendada"], r["qty_max_recomendada"]) for r in S.lot_bands(df, "q", "f", kind="t", lag="l", spread="s").collect()}
    # safety 20, stock 10: 110; 75 + 14 - 11 = 78; 125 + 24 = 149
    assert got == {"PT": (110.0, 75.0, 150.0), "PP": (100.0, 75.0, 125.0)}


def test_products_without_values_stay(spark):
    from siembra.plans.gold import cumulative_value

    got = {r["product_id"]: r["pct_acumulado"] for r in cumulative_value(spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None)], "product_id string, total double")).collect()}
    assert got == {"a": 75.0, "b": 100.0, "c": 100.0}


def test_bands_hold_their_order(spark):
    df = spark.createDataFrame([(12.0, 0.5), (0.0, None), (-3.0, 9.0), (None, 0.0)], "q double, f double")
    for r in S.lot_bands(df, "q", "f").collect():
        assert r["qty_min_recomendada"] <= r["qty_recomendada"] <= r["qty_max_recomendada"] and r["qty_recomendada"] % 5 == 0
