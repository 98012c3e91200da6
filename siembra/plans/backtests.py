"""Queries of backtests, learning curves and the stability of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siembra.operators import backtest as B
from siembra.operators import champions as CH
from siembra.operators import forecast as FC
from siembra.operators import metrics as ME
from siembra.operators import mining as M
from siembra.operators import panel as P
from siembra.operators import panel_matrix as PM
from siembra.operators import rule_stability as RS
from siembra.operators import tree_shapley as TS
from siembra.plans.panels import _GRID
from siembra.plans.registry import query
from siembra.sources.scratch import written
from siembra.sources.tables import SALES_SQL, monthly_panel, panel_sql, sales


#: The columns that backtests of linear models read.
_MODELLED = ("product_id", "periodo", "target_qty", "estado_producto", "es_estacional", "ultima_actividad", *FC.FEATURES)


def features(spark: SparkSession, sf_dir: str, by: str = "product_id", *wanted: str) -> DataFrame:
    """The feature matrix of products' months, written once; only the ``wanted`` columns of it are made, if any are named."""
    f = FC.prepared(P.complete_grid(monthly_panel(spark, sf_dir, by)))
    return written(f.select(*wanted) if wanted else f, "features")


@query("d17_walk_forward")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability by model and segment over six walk-forward folds of products."""
    f = written(PM.modelled(written(monthly_panel(spark, sf_dir, "product_id"), "panel"), FC.FEATURES), "features")
    return B.stability(B.fold_errors(B.walk_forward_backtest(f, FC.active_features(f), least_rows=50), ["fold_id"]))


@query("d18_learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lengths of training and their errors."""
    f = features(spark, sf_dir, "product_id", *_MODELLED)
    return B.learning_curve(f, FC.active_features(f), least_rows=50).withColumn("train_until", F.col("train_until").cast("string"))


@query(
    "d32_rolling_baselines",
    f"""
WITH p AS ({panel_sql('product_id')}), {_GRID},
h AS (SELECT product_id, periodo, CAST(target_qty AS DOUBLE) AS y, coalesce(lag(target_qty) OVER w, 0.0) AS l1, coalesce(lag(target_qty, 12) OVER w, 0.0) AS l12 FROM g WINDOW w AS (PARTITION BY product_id ORDER BY periodo)),
m AS (SELECT MAX(periodo) AS last FROM g),
f AS (SELECT k AS fold_id, last - to_months(CAST(8 - k AS INTEGER)) AS test_from, last - to_months(CAST(6 - k AS INTEGER)) AS test_until FROM m, (SELECT unnest(range(1, 7)) AS k)),
s AS (
 SELECT fold_id, 'lag_1' AS model_name, y, l1 AS p FROM h JOIN f ON periodo BETWEEN test_from AND test_until UNION ALL
 SELECT fold_id, 'lag_12', y, l12 FROM h JOIN f ON periodo BETWEEN test_from AND test_until UNION ALL
 SELECT fold_id, 'hybrid', y, CASE WHEN l12 > 0 THEN (l1 + l12) / 2 ELSE l1 END FROM h JOIN f ON periodo BETWEEN test_from AND test_until)
SELECT model_name, CAST(fold_id AS INTEGER) AS fold_id, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(sum(abs(y - p)) / sum(y), 6) AS wape, round(sum(p - y) / sum(y) * 100, 6) AS bias_pct, COUNT(*) AS n FROM s GROUP BY model_name, fold_id
""",
)
def rolling_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the three baselines in six rolling windows."""
    f = features(spark, sf_dir, "product_id", "product_id", "periodo", "target_qty", "lag_1", "lag_12")
    p = B.baseline_backtest(f)
    e = p.groupBy("model_name", "fold_id").agg(*ME.error_metrics("target_qty", "prediccion")).drop("smape")
    return e.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "wape", "bias_pct")})


_SPLIT = "CASE WHEN order_id % 10 < 6 THEN 'train' WHEN order_id % 10 < 8 THEN 'val' ELSE 'test' END"


@query(
    "m04_rule_consensus",
    f"""
WITH x AS (SELECT DISTINCT order_id, brand, {_SPLIT} AS s FROM ({SALES_SQL})), y AS (SELECT * FROM x WHERE order_id IN (SELECT order_id FROM x GROUP BY order_id HAVING COUNT(*) >= 2)),
n AS (SELECT COUNT(DISTINCT order_id) FILTER (s = 'train') AS t, COUNT(DISTINCT order_id) FILTER (s = 'val') AS v, COUNT(DISTINCT order_id) FILTER (s = 'test') AS u FROM y),
i AS (SELECT brand, COUNT(*) FILTER (s = 'train') AS t, COUNT(*) FILTER (s = 'val') AS v, COUNT(*) FILTER (s = 'test') AS u FROM y GROUP BY brand),
p AS (SELECT a.brand AS antecedent, b.brand AS consequent, COUNT(*) FILTER (a.s = 'train') AS t, COUNT(*) FILTER (a.s = 'val') AS v, COUNT(*) FILTER (a.s = 'test') AS u FROM y a JOIN y b ON a.order_id = b.order_id AND a.brand <> b.brand GROUP BY ALL),
r AS (
 SELECT antecedent, consequent, p.t / n.t AS support, p.t / a.t AS confidence, p.t::DOUBLE * n.t / (a.t * b.t) AS lift, p.v / n.v AS support_val, p.v / a.v AS conf_val, p.u / n.u AS support_test, p.u / a.u AS conf_test
 FROM p JOIN i a ON a.brand = antecedent JOIN i b ON b.brand = consequent, n),
f AS (
 SELECT *, (CAST(support_val >= 0.005 AND conf_val >= 0.05 AS INTEGER) + CAST(support_test >= 0.005 AND conf_test >= 0.05 AS INTEGER)) / 2 AS estabilidad_split
 FROM r WHERE support >= 0.005 AND confidence >= 0.05 AND conf_val >= 0.1 AND conf_test >= 0.1 AND greatest(support_val, support_test) >= 0.005),
k AS (
 SELECT *, (rank() OVER (ORDER BY round(lift, 9)) + (COUNT(*) OVER (PARTITION BY round(lift, 9)) - 1) / 2) / COUNT(*) OVER () AS kl, (rank() OVER (ORDER BY round(confidence, 9)) + (COUNT(*) OVER (PARTITION BY round(confidence, 9)) - 1) / 2) / COUNT(*) OVER () AS kc,
  (rank() OVER (ORDER BY round(conf_test, 9)) + (COUNT(*) OVER (PARTITION BY round(conf_test, 9)) - 1) / 2) / COUNT(*) OVER () AS kt FROM f)
SELECT antecedent, consequent, round(lift, 6) AS lift, round(confidence, 6) AS confidence, round(conf_val, 6) AS conf_val, round(conf_test, 6) AS conf_test, CAST(estabilidad_split AS DOUBLE) AS estabilidad_split, round(0.3 * kl + 0.25 * kc + 0.25 * kt + 0.2 * estabilidad_split, 6) AS score_consenso FROM k
""",
)
def rule_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand rules of the training orders that hold in the later ones, with their consensus score."""
    r = F.col("order_id") % 10
    lines = sales(spark, sf_dir, "order_id", "brand").withColumn("s", F.when(r < 6, "train").when(r < 8, "val").otherwise("test"))
    out = RS.consensus(lines, "order_id", "brand", "s", 0.005, 0.05, top=14_400)
    return out.select("antecedent", "consequent", *(F.round(c, 6).alias(c) for c in ("lift", "confidence", "conf_val", "conf_test")), "estabilidad_split", F.round("score_consenso", 6).alias("score_consenso"))


@query("m09_bootstrap_rules")
def bootstrap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand rules with the share of thirty bootstrap resamples that find them."""
    pairs = M.baskets(sales(spark, sf_dir, "order_id", "brand"), "order_id", "brand")
    return RS.bootstrap(pairs, "order_id", "brand", min_support=0.005, min_confidence=0.12).drop("en_muestras")


_KINDS = """CASE WHEN nz = 0 THEN 'sin_historia' WHEN nz < 6 THEN 'poca_historia' WHEN nz / n < 0.3 THEN 'intermitente' ELSE 'regular' END"""


@query(
    "d31_segment_champions",
    f"""
WITH p AS ({panel_sql('product_id')}), {_GRID},
h AS (SELECT product_id, periodo, CAST(target_qty AS DOUBLE) AS y, coalesce(lag(target_qty) OVER w, 0.0) AS l1, coalesce(lag(target_qty, 12) OVER w, 0.0) AS l12 FROM g WINDOW w AS (PARTITION BY product_id ORDER BY periodo)),
m AS (SELECT MAX(periodo) AS last FROM g),
s AS (SELECT *, CASE WHEN periodo > last - INTERVAL 3 MONTH THEN 'test' WHEN periodo > last - INTERVAL 6 MONTH THEN 'val' ELSE 'train' END AS parte FROM h, m),
k AS (SELECT product_id, COUNT(*) FILTER (parte = 'train') AS n, COUNT(*) FILTER (parte = 'train' AND y > 0) AS nz FROM s GROUP BY product_id),
r AS (SELECT s.*, {_KINDS} AS tipo, CASE WHEN CAST(s.product_id AS BIGINT) % 5 = 0 THEN CAST(s.product_id AS BIGINT) % 900 ELSE CAST(s.product_id AS BIGINT) % 20 END AS categoria, CASE WHEN l12 > 0 THEN (l1 + l12) / 2 ELSE l1 END AS hy FROM s JOIN k USING (product_id)),
e AS (
 SELECT tipo, CAST(categoria AS VARCHAR) AS categoria, parte, y, 'lag_1' AS modelo, l1 AS p FROM r UNION ALL SELECT tipo, CAST(categoria AS VARCHAR), parte, y, 'lag_12', l12 FROM r UNION ALL SELECT tipo, CAST(categoria AS VARCHAR), parte, y, 'hybrid', hy FROM r),
a AS (
 SELECT CASE WHEN grouping(tipo) = 1 THEN NULL ELSE tipo END AS tipo, CASE WHEN grouping(categoria) = 1 THEN NULL ELSE categoria END AS categoria, 2 - grouping(tipo) - grouping(categoria) AS depth, modelo,
  COUNT(*) FILTER (parte = 'train') AS n_train, COUNT(*) FILTER (parte = 'val') AS n_val, COUNT(*) FILTER (parte = 'test') AS n_test,
  round(sum(abs(y - p)) FILTER (parte = 'val') / sum(y) FILTER (parte = 'val'), 9) AS wape, round(abs(sum(p - y) FILTER (parte = 'val') / sum(y) FILTER (parte = 'val')), 9) AS bias,
  round(avg(CASE WHEN y + p > 0 THEN 2 * abs(y - p) / (y + p) ELSE 0 END) FILTER (parte = 'val'), 6) AS smape
 FROM e GROUP BY GROUPING SETS ((modelo), (tipo, modelo), (tipo, categoria, modelo))),
b AS (SELECT *, coalesce(wape, 1e300) AS w, coalesce(bias, 1e300) AS bb FROM a),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY depth, tipo, categoria ORDER BY w, bb, smape, modelo) = 1),
o AS (SELECT * FROM c WHERE depth = 0 OR n_train >= 60 AND n_val >= 10 AND n_test >= 10)
SELECT l.tipo, l.categoria, coalesce(x.modelo, t.modelo, g.modelo) AS modelo, CASE WHEN x.modelo IS NOT NULL THEN 'segment_specific' WHEN t.modelo IS NOT NULL THEN 'fallback_parent' ELSE 'fallback_global' END AS modo, l.n_train, l.n_val, l.n_test
FROM (SELECT * FROM c WHERE depth = 2) l LEFT JOIN o x ON x.depth = 2 AND x.tipo = l.tipo AND x.categoria = l.categoria LEFT JOIN o t ON t.depth = 1 AND t.tipo = l.tipo JOIN o g ON g.depth = 0
""",
)
def segment_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines routed by how intermittent a product was in training, and by category within."""
    f = features(spark, sf_dir, "product_id", "product_id", "periodo", "target_qty", "lag_1", "lag_12")
    last = f.agg(F.max("periodo").alias("m")).scalar()
    part = F.when(F.col("periodo") > F.add_months(last, -3), "test").when(F.col("periodo") > F.add_months(last, -6), "val").otherwise("train")
    rows = written(FC.baselines(f.withColumn("parte", part)).select("product_id", "periodo", "target_qty", "parte", *(F.col(f"{m}_pred").alias(m) for m in B.BASELINES)), "scored")
    past = rows.groupBy("product_id").agg(F.count_if(F.col("parte") == "train").alias("n"), F.count_if((F.col("parte") == "train") & (F.col("target_qty") > 0)).alias("nz"))
    kind = F.when(F.col("nz") == 0, "sin_historia").when(F.col("nz") < 6, "poca_historia").when(F.col("nz") / F.col("n") < 0.3, "intermitente").otherwise("regular")
    number = F.col("product_id").cast("long")
    rows = rows.join(past.select("product_id", kind.alias("tipo")), "product_id").withColumn("categoria", F.when(number % 5 == 0, number % 900).otherwise(number % 20))
    return CH.champions(rows, ["tipo", "categoria"], "parte", "target_qty", list(B.BASELINES))


def _explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The last three months of brands with the Shapley values (in the logarithm) of the random forest fitted on the months before."""
    f = features(spark, sf_dir, "brand")
    split = ME.holdout(ME.periods_of(f), validation=0)
    before = f.where(F.col("periodo").isin(split["train"]))
    columns = FC.active_features(before)
    model = FC.fit(FC.trainable(before), FC.models()["random_forest_conservative"], columns)
    return written(TS.explained(f.where(F.col("periodo").isin(split["test"])), TS.of_model(model.stages[-1]), columns), "explained"), columns


@query("m16_shap_global")
def shap_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size and mean of every feature's contribution over the test months."""
    rows, columns = _explained(spark, sf_dir)
    return TS.importance(rows, columns)


@query("m16_shap_products")
def shap_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest features of the twenty products of most volume in the test months."""
    rows, columns = _explained(spark, sf_dir)
    return TS.product_importance(rows, columns)
