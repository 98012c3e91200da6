"""Work that a plan does once a row, or once for baskets of the same items."""

import datetime

from pyspark.sql import functions as F

from siembra.functions import dates as D
from siembra.functions import numeric as N
from siembra.operators import catalogue as C
from siembra.operators import rule_stability as RS
from siembra.plans import catalogue as PC


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ledger_text_is_cleaned_once(spark):
    texts = [("(1.234,56)", -1234.56), ("$ 1,234.56", 1234.56), ("1.234.567", 1234567.0), ("−5\t%", -5.0), ("(\xa07)", -7.0), ("1e3", 1000.0), ("1,5E2", 150.0), ("none", None), ("", None), ("12\x85", None), ("1.2.3", 12.3), (None, None)]
    df = spark.createDataFrame(texts, "t string, x double").repartition(1)
    out = df.select("x", N.parse_ledger_number(F.col("t")).alias("y"))
    assert optimised(out).count("translate(") == 1
    assert all(r["x"] == r["y"] for r in out.collect())


def test_sales_code_is_sought_once(spark):
    rows = [("m", "f", "P (12)", 2024, "enero", 1, 2.0, 3.0), ("m", "f", "P (12)", 2024, " ENÉRO", 1, 2.0, 3.0), ("m", "f", "P", 2024, "trece", 1, 2.0, 3.0), ("m", "f", "P", 0, "mayo", 1, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "marca string, familia string, producto string, anio int, mes string, recuento_cliente int, cantidad double, ventas double").repartition(1)
    out = C.clean_monthly_sales(df)
    assert optimised(out).count("regexp_extract(") == 1
    assert [tuple(r) for r in out.collect()] == [("m", "f", "P (12)", "0012", datetime.date(2024, 1, 1), 2.0, 4.0, 6.0)]


def test_month_names(spark):
    df = spark.createDataFrame([(" Setiembre ", 9), ("diciémbre", 12), ("x", None), (None, None)], "t string, n int")
    assert all(r["n"] == r["m"] for r in df.select("n", D.month_number(F.col("t")).alias("m")).collect())


def test_baskets_of_the_same_items_are_one_row(spark, monkeypatch):
    kept = []
    written = RS.written
    monkeypatch.setattr(RS, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    pairs = spark.createDataFrame([(b, i) for b in range(40) for i in ("x", "y")] + [(99, "x"), (99, "z")], "b int, i string")
    out = {(r["antecedent"], r["consequent"]): (r["ab_base"], r["a_base"], r["b_base"], r["n_base"]) for r in RS._counted(pairs, "b", "i", {"base": F.lit(1)}).collect()}
    assert kept[0].count() == 2
    assert out == {("x", "y"): (40, 41, 40, 41), ("y", "x"): (40, 40, 41, 41), ("x", "z"): (1, 41, 1, 41), ("z", "x"): (1, 1, 41, 41)}


def test_forecasting_base_reads_lines_and_names_once(spark):
    """Repeated rows, products of one code and twins of finished ones; no plan goes back to the lines or normalises names by month."""
    base = PC.forecasting_base(spark, "/root/testdata/sf0.001")
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "translate" not in plan
    month = lambda m: datetime.date(2024, m, 1)
    rows = [("m", " f", p, c, month(t), 1.0, q, 2.0) for p, c, t, q in (("B", "0009", 1, 1.0), ("B", "0009", 1, 2.0), ("A", "0009", 1, -1.0), ("A x", "0009", 2, 0.0), ("Sal", "", 2, 1.0), ("sál", "", 2, 1.0), ("Ajo", "0001", 2, 1.0))]
    sales = spark.createDataFrame(rows, "marca string, familia string, producto string, codigo_producto string, periodo date, recuento_cliente double, cantidad double, ventas double")
    dim = spark.createDataFrame([("0001", "", "PT:SAL", "SAL", "PT", False)], "codigo_producto string, ean13 string, item_canonico string, producto_dashboard string, tipo_producto string, flag_conflicto_ean13 boolean")
    got = {(r.codigo_producto, r.periodo.month): (r.producto_item, r.producto_dashboard, r.tipo_producto, r.categoria_producto, r.estado_producto, r.qty_vendida, r.clientes) for r in C.forecasting_base(sales, dim).collect()}
    assert got == {("0009", 1): ("B", "B", "OTRO", "F", "ESTACIONAL", 2.0, 3.0), ("0009", 2): ("A x", "A x", "OTRO", "F", "ESTACIONAL", 0.0, 1.0), ("0001", 2): ("PT:SAL", "SAL", "PT", "F", "ESTACIONAL", 1.0, 1.0)}
