"""Stock matches, policies, valuation and templates on rows worked out by hand."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from siembra.operators import inventory as I
from siembra.operators import relational as R

PRODUCT = "product_id string, match_key string, product_key_type string, product_priority int"
STOCK = "match_key string, stock_key_type string, stock_priority int, stock_item string, stock_item_description string, stock_actual double, stock_avg_cost double, stock_asset_value double, stock_fecha_referencia date"


def matched(spark, stock):
    products = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "product_id string, x int")
    keys = spark.createDataFrame([("a", "k1", "codigo", 1), ("a", "k1", "codigo", 1), ("a", "n", "nombre", 3), ("b", "n", "nombre", 2), ("c", None, "codigo", 1)], PRODUCT)
    return I.current_stock(products, keys, spark.createDataFrame(stock, STOCK))


def test_best_pair_of_keys_and_products_without_stock(spark):
    day = date(2024, 1, 1)
    stock = [("n", "nombre", 1, "I1", "", 5.0, 2.0, 10.0, day), ("k1", "codigo", 2, "I2", "d", 7.0, 1.5, None, None), ("k1", "codigo", 2, "I2", "d", 8.0, 1.5, 9.0, day), (None, "codigo", 1, "I0", "", 1.0, 1.0, 1.0, day)]
    got = {r.product_id: r for r in matched(spark, stock).collect()}
    assert len(got) == 3
    assert (got["a"].stock_item, got["a"].stock_actual, got["a"].stock_match_status, got["a"].stock_fecha_referencia) == ("I2", 8.0, "codigo_vs_codigo", day)
    assert (got["b"].stock_item, got["b"].stock_encontrado) == ("I1", True)
    assert (got["c"].stock_item, got["c"].stock_actual, got["c"].stock_encontrado, got["c"].stock_match_status) == ("", 0.0, False, "sin_match_stock")
    assert {r.stock_match_status for r in matched(spark, []).collect()} == {"sin_match_stock"}


def test_policy_valuation_and_templates(spark):
    stock = matched(spark, [("k1", "codigo", 1, "I", "", 10.0, 0.125, 1.0, None), ("n", "nombre", 1, "J", "", 90.0, 2.0, 1.0, None)])
    policy = spark.createDataFrame([("a", "1", "2", 1), ("a", "4", "x", 2), ("b", None, "50", 1)], "product_id string, stock_minimo string, stock_maximo string, n int")
    rules = {r.product_id: (r.stock_minimo, r.stock_maximo) for r in I.stock_policy(policy, "n").collect()}
    assert rules == {"a": (4.0, None), "b": (0.0, 50.0)}
    demand = spark.createDataFrame([(p, date(2024, m, 1), q) for p, m, q in (("a", 1, 8.0), ("a", 2, 6.0), ("b", 1, 30.0), ("c", 1, 5.0), ("z", 1, 1.0))], "product_id string, periodo date, cantidad_predicha double")
    out = {(r.product_id, r.periodo.month): r for r in I.adjusted_for_stock(demand, stock, I.stock_policy(policy, "n")).collect()}
    first, second = out["a", 1], out["a", 2]
    assert (first.cantidad_a_producir_ajustada, first.stock_proyectado_fin, first.alerta_inventario, first.valor_stock_actual, first.valor_produccion_ajustada) == (2.0, 4.0, "dentro_rango", 1.25, 0.25)
    assert (second.stock_proyectado_inicio, second.cantidad_a_producir_ajustada, second.valor_produccion_ajustada) == (4.0, 6.0, 0.75)
    assert (out["b", 1].alerta_inventario, out["b", 1].cantidad_a_producir_ajustada, out["b", 1].valor_stock_actual) == ("sobrestock", 0.0, 180.0)
    assert out["c", 1].alerta_inventario == out["z", 1].alerta_inventario == "sin_stock_actual" and out["z", 1].valor_produccion_ajustada == 0.0
    blank = I.policy_template(spark.createDataFrame([("a",), ("q",)], "product_id string"), stock).collect()
    assert {r.product_id: (r.stock_actual, r.stock_minimo) for r in blank} == {"a": (10.0, ""), "q": (None, "")}
    with_source = demand.selectExpr("'PT' source_type", "*")
    errors = spark.createDataFrame([("PT", "b", 9.0, 0.3, "alta")], "source_type string, product_id string, error_absoluto_total double, wape_producto double, prioridad_revision string")
    review = I.expert_template(with_source, errors, 3).collect()
    assert [(r.product_id, r.prioridad_revision, r.criterio_experto) for r in review] == [("b", "alta", ""), ("a", "normal", ""), ("c", "normal", "")]


def test_one_stock_row_of_a_key_is_joined(spark):
    """A key that many products and many stock rows share adds one pair a product; the best pairs stay the same."""
    products = spark.range(300).selectExpr("cast(id as string) AS product_id")
    keys = products.selectExpr("product_id", "inline(array(struct('hot' AS match_key, 'nombre' AS product_key_type, 2 AS product_priority), struct(concat('c', cast(product_id as int) % 50) AS match_key, 'codigo' AS product_key_type, 1 AS product_priority)))")
    rows = [("hot", "nombre", 2, f"I{k:03d}", "", float(k), 1.0, 1.0, None) for k in range(399, -1, -1)] + [(f"c{k}", "codigo", 1 + k % 3, f"C{j}{k}", "", 1.0, 1.0, 1.0, None) for k in range(25) for j in (2, 1)]
    out = I.current_stock(products, keys, spark.createDataFrame(rows, STOCK)).cache()
    got = {int(r.product_id): (r.stock_item, r.stock_match_status) for r in out.collect()}
    assert got == {k: (f"C1{k % 50}", "codigo_vs_codigo") if k % 50 < 25 else ("I000", "nombre_vs_nombre") for k in range(300)}
    joined = largest_join(I.current_stock(products, keys, spark.createDataFrame(rows, STOCK)))
    assert 0 < joined <= 600


def test_one_row_of_a_key_is_joined_among_equals(spark):
    left = spark.range(300).selectExpr("id AS p", "'hot' AS k", "cast(id % 3 as int) AS a").union(spark.sql("SELECT 300L, NULL, 0"))
    right = spark.range(400).selectExpr("id AS s", "if(id = 7, NULL, 'hot') AS k", "cast(2 - id % 2 as int) AS b")
    best = lambda: R.candidate_best(left, right, "k", "p", F.col("a") + F.col("b"), "a", "b", "s", among=("b", "s"))
    assert {(r.p, r.s, r.b) for r in best().collect()} == {(k, 1, 1) for k in range(300)}
    assert 0 < largest_join(best()) <= 300


def largest_join(df):
    """Rows that the largest join of a run made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    rows, todo = [], [plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("Join"):
            rows.append(node.metrics().apply("numOutputRows").value())
        todo += [node.plan()] if hasattr(node, "plan") and node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
    return max(rows)
