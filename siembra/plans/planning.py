"""Planning queries: baselines and errors, stock projections, decisions, matching, models, stream windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siembra.operators import backtest as BT
from siembra.operators import decision as DC
from siembra.operators import forecast as FC
from siembra.operators import inventory as I
from siembra.operators import match as MT
from siembra.operators import metrics as ME
from siembra.operators import panel as P
from siembra.plans.panels import _GRID, text_month
from siembra.plans.registry import query
from siembra.sources.scratch import shared_folder, written
from siembra.sources.tables import monthly_panel, panel_sql, table
from siembra.streaming import events as S

_LAG = f"""WITH p AS ({panel_sql('product_id')}), {_GRID},
b AS (SELECT product_id, periodo, target_qty AS y, coalesce(lag(target_qty) OVER (PARTITION BY product_id ORDER BY periodo), 0.0) AS f FROM g),
t AS (SELECT * FROM b WHERE periodo > (SELECT MAX(periodo) FROM g) - INTERVAL 12 MONTH)"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last month's quantity as the forecast of the last twelve months."""
    g = written(P.complete_grid(monthly_panel(spark, sf_dir, "product_id")), "grid")
    lag = F.coalesce(F.lag("target_qty").over(Window.partitionBy("product_id").orderBy("periodo")), F.lit(0.0))
    last = g.agg(F.max("periodo").alias("m")).scalar()
    return g.select("product_id", "periodo", F.col("target_qty").alias("y"), lag.alias("f")).where(F.col("periodo") > F.add_months(last, -12))


@query(
    "g29_error_metrics",
    f"""{_LAG}
SELECT periodo::VARCHAR AS periodo, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(CASE WHEN y + f > 0 THEN 2 * abs(y - f) / (y + f) ELSE 0 END), 6) AS smape,
 CASE WHEN sum(y) > 0 THEN round(sum(abs(y - f)) / sum(y), 6) ELSE 0.0 END AS wape, CASE WHEN sum(y) > 0 THEN round(sum(f - y) / sum(y) * 100, 6) ELSE 0.0 END AS bias_pct, COUNT(*) AS n FROM t GROUP BY periodo""",
)
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _baseline(spark, sf_dir).groupBy("periodo").agg(*ME.error_metrics("y", "f"))
    return text_month(e).withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "smape", "wape", "bias_pct")})


@query(
    "g30_high_error_products",
    f"""{_LAG},
e AS (SELECT product_id, CAST(sum(y) AS DOUBLE) AS cantidad_real_total, CAST(sum(f) AS DOUBLE) AS cantidad_predicha_total, CAST(sum(abs(y - f)) AS DOUBLE) AS error_absoluto_total FROM t GROUP BY product_id)
SELECT *, CASE WHEN cantidad_real_total > 0 THEN error_absoluto_total / cantidad_real_total ELSE 0.0 END AS wape_producto,
 CASE WHEN (rank() OVER (ORDER BY error_absoluto_total DESC) + (COUNT(*) OVER (PARTITION BY error_absoluto_total) - 1) / 2.0) / COUNT(*) OVER () <= 0.2 THEN 'alta' ELSE 'normal' END AS prioridad_revision FROM e""",
)
def high_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.high_error_products(_baseline(spark, sf_dir), "product_id", "y", "f")


@query(
    "g36_plan_quality",
    """
WITH o AS (SELECT l_orderkey, SUM(l_quantity) AS plan, SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS made FROM lineitem GROUP BY l_orderkey)
SELECT avg(CAST(plan = made AS DOUBLE)) AS exactos, avg(CAST(abs(plan - made) <= 0.05 * abs(made) AS DOUBLE)) AS dentro_5, round(corr(plan, made), 6) AS correlacion, round(sum(abs(plan - made)) / sum(made), 6) AS wape, COUNT(DISTINCT plan) > 1 AS informativo FROM o
""",
)
def plan_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("plan"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("made"))
    return ME.plan_quality(o, "plan", "made").withColumns({c: F.round(c, 6) for c in ("correlacion", "wape")})


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six months of brands as demand, with a stock that is half of the first one."""
    p = monthly_panel(spark, sf_dir)
    last = p.agg(F.max("periodo").alias("m")).scalar()
    d = p.where(F.col("periodo") > F.add_months(last, -6)).select("product_id", "periodo", F.col("target_qty").alias("cantidad_predicha"))
    first = F.first("cantidad_predicha").over(Window.partitionBy("product_id").orderBy("periodo"))
    return d.withColumns({"stock_actual": first / 2, "stock_minimo": F.lit(10.0), "stock_maximo": F.lit(600.0), "stock_encontrado": F.lit(True)})


@query(
    "w24_stock_projection",
    f"""
WITH RECURSIVE p AS ({panel_sql()}), d AS (SELECT product_id, periodo, target_qty AS q, row_number() OVER (PARTITION BY product_id ORDER BY periodo) AS k FROM p WHERE periodo > (SELECT MAX(periodo) FROM p) - INTERVAL 6 MONTH),
r AS (
 SELECT product_id, periodo, k, q / 2 AS s, least(greatest(q + 10 - q / 2, 0), greatest(600 - q / 2, 0)) AS m, q / 2 + least(greatest(q + 10 - q / 2, 0), greatest(600 - q / 2, 0)) - q AS e FROM d WHERE k = 1
 UNION ALL SELECT d.product_id, d.periodo, d.k, r.e, least(greatest(d.q + 10 - r.e, 0), greatest(600 - r.e, 0)), r.e + least(greatest(d.q + 10 - r.e, 0), greatest(600 - r.e, 0)) - d.q FROM r JOIN d ON d.product_id = r.product_id AND d.k = r.k + 1)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, CAST(s AS DOUBLE) AS stock_proyectado_inicio, CAST(e AS DOUBLE) AS stock_proyectado_fin, CAST(m AS DOUBLE) AS cantidad_a_producir_ajustada,
 CASE WHEN s > 600 THEN 'sobrestock' WHEN e < 10 THEN 'riesgo_quiebre_stock' ELSE 'dentro_rango' END AS alerta_inventario FROM r
""",
)
def stock_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_month(I.project_stock(_demand(spark, sf_dir)))


_STOCK = f"""
p AS ({panel_sql('product_id')}), d AS (SELECT product_id, periodo, target_qty AS q, row_number() OVER (PARTITION BY product_id ORDER BY periodo) AS k FROM p WHERE periodo > (SELECT MAX(periodo) FROM p) - INTERVAL 4 MONTH),
pk AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'code:' || p_partkey % 997 AS match_key, 'codigo' AS pt, 1 AS pp FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), upper(p_brand), 'marca', 2 FROM part),
sk AS (SELECT s_suppkey, 'code:' || s_suppkey % 89 AS match_key, 'codigo' AS st, 1 AS sp FROM supplier UNION ALL SELECT s_suppkey, 'BRAND#' || s_suppkey % 40, 'nombre', 2 FROM supplier),
b AS (SELECT product_id, s_name, floor(abs(s_acctbal) / 100) AS stock, s_nationkey + 0.25::DOUBLE AS cost, pt || '_vs_' || st AS status FROM pk JOIN sk USING (match_key) JOIN supplier USING (s_suppkey) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY pp + sp, pp, sp, s_name) = 1),
x AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, coalesce(stock, 0) AS stock, stock IS NOT NULL AS found, coalesce(status, 'sin_match_stock') AS status, coalesce(s_name, '') AS item, coalesce(cost, 0.0) AS cost,
  CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 0 END AS lo, CASE WHEN p_partkey % 7 < 2 THEN 40 + p_partkey % 11 END AS hi FROM part LEFT JOIN b ON b.product_id = CAST(p_partkey AS VARCHAR))"""


def _stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers' balances as stock items, matched by code and by name."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), (F.col("p_partkey") % 997).cast("string").alias("c"), F.upper("p_brand").alias("b"))
    supplier = table(spark, sf_dir, "supplier").withColumns({"stock_item": F.col("s_name"), "stock_item_description": F.lit(""), "stock_actual": F.floor(F.abs("s_acctbal") / 100).cast("double"), "stock_avg_cost": F.col("s_nationkey") + 0.25, "stock_asset_value": F.col("s_acctbal"), "stock_fecha_referencia": F.lit("2024-01-01").cast("date")})
    key = lambda k, kind, rank, side: F.struct(k.alias("match_key"), F.lit(kind).alias(f"{side}_key_type"), F.lit(rank).alias(f"{side}_priority"))
    ours = part.select("product_id", F.inline(F.array(key(F.concat(F.lit("code:"), "c"), "codigo", 1, "product"), key(F.col("b"), "marca", 2, "product"))))
    number = F.col("s_suppkey")
    theirs = supplier.select("stock_item", "stock_item_description", "stock_actual", "stock_avg_cost", "stock_asset_value", "stock_fecha_referencia", F.inline(F.array(key(F.concat(F.lit("code:"), (number % 89).cast("string")), "codigo", 1, "stock"), key(F.concat(F.lit("BRAND#"), (number % 40).cast("string")), "nombre", 2, "stock"))))
    return I.current_stock(part, ours, theirs)


@query(
    "d21_stock_valuation",
    f"""
WITH RECURSIVE {_STOCK},
r AS (
 SELECT product_id, periodo, k, stock AS s, least(greatest(q + lo - stock, 0), CASE WHEN hi IS NULL THEN 1e18 ELSE greatest(hi - stock, 0) END) AS m, stock + least(greatest(q + lo - stock, 0), CASE WHEN hi IS NULL THEN 1e18 ELSE greatest(hi - stock, 0) END) - q AS e FROM d JOIN x USING (product_id) WHERE k = 1
 UNION ALL SELECT d.product_id, d.periodo, d.k, r.e, least(greatest(d.q + lo - r.e, 0), CASE WHEN hi IS NULL THEN 1e18 ELSE greatest(hi - r.e, 0) END), r.e + least(greatest(d.q + lo - r.e, 0), CASE WHEN hi IS NULL THEN 1e18 ELSE greatest(hi - r.e, 0) END) - d.q FROM r JOIN d ON d.product_id = r.product_id AND d.k = r.k + 1 JOIN x ON x.product_id = d.product_id)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, CAST(stock AS DOUBLE) AS stock_actual, found AS stock_encontrado, status AS stock_match_status, item AS stock_item, CAST(m AS DOUBLE) AS cantidad_a_producir_ajustada, CAST(e AS DOUBLE) AS stock_proyectado_fin,
 CASE WHEN NOT found THEN 'sin_stock_actual' WHEN s > hi THEN 'sobrestock' WHEN e < lo THEN 'riesgo_quiebre_stock' ELSE 'dentro_rango' END AS alerta_inventario, CAST(stock * cost AS DOUBLE) AS valor_stock_actual, CAST(m * cost AS DOUBLE) AS valor_produccion_ajustada FROM r JOIN x USING (product_id)
""",
)
def stock_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four months of demand of every part against its stock and the last version of its policy, valued at cost."""
    p = written(monthly_panel(spark, sf_dir, "product_id"), "panel")
    last = p.agg(F.max("periodo").alias("m")).scalar()
    demand = p.where(F.col("periodo") > F.add_months(last, -4)).select("product_id", "periodo", F.col("target_qty").alias("cantidad_predicha"))
    k = F.col("p_partkey")
    old = table(spark, sf_dir, "part").select(k.cast("string").alias("product_id"), F.lit("5").alias("stock_minimo"), F.lit("9").alias("stock_maximo"), F.lit(1).alias("version"))
    new = table(spark, sf_dir, "part").select(k.cast("string").alias("product_id"), F.when(k % 7 == 0, "10").otherwise("").alias("stock_minimo"), F.when(k % 7 < 2, (k % 11 + 40).cast("string")).otherwise("n/a").alias("stock_maximo"), F.lit(2).alias("version"))
    out = I.adjusted_for_stock(demand, _stock(spark, sf_dir), I.stock_policy(old.unionByName(new), "version"))
    return text_month(out.select("product_id", "periodo", "stock_actual", "stock_encontrado", "stock_match_status", "stock_item", "cantidad_a_producir_ajustada", "stock_proyectado_fin", "alerta_inventario", "valor_stock_actual", "valor_produccion_ajustada"))


@query(
    "d22_policy_template",
    f"WITH {_STOCK} SELECT product_id, stock AS stock_actual, found AS stock_encontrado, status AS stock_match_status, '' AS stock_minimo, '' AS stock_maximo, '' AS lead_time_dias, '' AS lote_minimo_produccion, '' AS observacion FROM x",
)
def policy_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.policy_template(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id")), _stock(spark, sf_dir))


@query(
    "d22_expert_template",
    f"""{_LAG}, e AS (SELECT product_id, CAST(sum(y) AS DOUBLE) AS y, CAST(sum(abs(y - f)) AS DOUBLE) AS error_absoluto_total FROM t GROUP BY product_id),
w AS (SELECT product_id, error_absoluto_total, CASE WHEN y > 0 THEN error_absoluto_total / y ELSE 0.0 END AS wape_producto, CASE WHEN (rank() OVER (ORDER BY error_absoluto_total DESC) + (COUNT(*) OVER (PARTITION BY error_absoluto_total) - 1) / 2.0) / COUNT(*) OVER () <= 0.2 THEN 'alta' ELSE 'normal' END AS prioridad_revision FROM e)
SELECT 'PT' AS source_type, product_id, CAST(periodo AS VARCHAR) AS periodo, f AS cantidad_predicha, error_absoluto_total, wape_producto, coalesce(prioridad_revision, 'normal') AS prioridad_revision, '' AS criterio_experto, '' AS cantidad_ajustada_experto, '' AS motivo_ajuste, '' AS responsable_revision
FROM t LEFT JOIN w USING (product_id) WHERE periodo = (SELECT MIN(periodo) FROM t) ORDER BY f DESC, product_id LIMIT 120""",
)
def expert_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the last twelve months as the month ahead, with the products' errors over all twelve."""
    b = written(_baseline(spark, sf_dir), "baseline").withColumn("source_type", F.lit("PT"))
    errors = ME.high_error_products(b, "product_id", "y", "f").withColumn("source_type", F.lit("PT"))
    return text_month(I.expert_template(b.select("source_type", "product_id", "periodo", F.col("f").alias("cantidad_predicha")), errors))


@query("w25_demand_scenarios")
def demand_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _demand(spark, sf_dir).withColumns({"prediccion_min": F.col("cantidad_predicha") * 0.8, "prediccion_max": F.col("cantidad_predicha") * 1.2})
    return text_month(I.scenarios(d))


@query(
    "d20_decisions",
    f"""{_LAG},
s AS (SELECT product_id, MAX(periodo) AS m, CAST(sum(abs(y - f)) AS DOUBLE) AS error, CAST(sum(y) AS DOUBLE) AS y, MAX(f) AS pred FROM t GROUP BY product_id),
q AS (SELECT product_id, error, pred, CASE WHEN y > 0 THEN 'activo' ELSE 'inactivo' END AS estado, length(product_id) % 2 = 0 AS est, CASE WHEN y > 0 THEN error / y END AS w, CASE WHEN error > 60 THEN 'alta' ELSE 'normal' END AS prio FROM s),
r AS (SELECT *, greatest(least(greatest(coalesce(w, 0.08), 0.0), 2.0), 0.08, CASE WHEN estado = 'inactivo' THEN 0.20 WHEN est THEN 0.15 ELSE 0.07 END) AS base FROM q),
a AS (SELECT *, least(base + CASE WHEN prio = 'alta' THEN 0.01 ELSE 0 END + CASE WHEN est THEN 0.01 ELSE 0 END, 2.0) AS riesgo FROM r),
c AS (SELECT *, CASE WHEN estado = 'inactivo' THEN 'no_aplica' WHEN riesgo <= 0.09 THEN 'alta' WHEN riesgo <= 0.16 THEN 'media' ELSE 'baja' END AS conf FROM a),
v AS (SELECT *, (conf = 'baja' OR prio = 'alta' OR est) AND estado <> 'inactivo' AS rev FROM c),
z AS (SELECT *, estado = 'activo' AND conf IN ('media', 'alta') AND NOT est AND NOT rev AS auto FROM v)
SELECT product_id, conf AS confianza_prediccion, rev AS requiere_revision, auto AS apto_automatizacion,
 CASE WHEN estado = 'inactivo' THEN 'no producir por inactividad' WHEN auto THEN 'usar como cantidad sugerida' WHEN rev THEN 'revisar antes de ordenar' ELSE 'revision por umbral operativo' END AS recomendacion_decision FROM z
""",
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision layer over lag-1 forecasts of parts; even-length ids count as seasonal."""
    e = written(_baseline(spark, sf_dir).groupBy("product_id").agg(F.sum(F.abs(F.col("y") - F.col("f")).cast("decimal(24,6)")).cast("double").alias("e"), F.sum(F.col("y").cast("decimal(24,6)")).cast("double").alias("y"), F.max("f").alias("pred"), F.max("periodo").alias("periodo")), "errors")
    p = e.select("product_id", "periodo", F.col("pred").alias("cantidad_predicha"), F.when(F.col("y") > 0, "activo").otherwise("inactivo").alias("estado_producto"), (F.length("product_id") % 2 == 0).alias("es_estacional"))
    errors = e.select("product_id", F.col("e").alias("error_absoluto_total"), F.when(F.col("y") > 0, F.col("e") / F.col("y")).alias("wape_producto"), F.when(F.col("e") > 60, "alta").otherwise("normal").alias("prioridad_revision"))
    segments = spark.createDataFrame([("activos_no_estacionales", True, 0.06, 0.01, 1.0), ("activos_estacionales", False, 0.11, 0.04, 0.5), ("inactivos", False, 0.20, 0.0, 0.0)], "segmento string, segmento_apto_automatizacion boolean, mean_wape double, std_wape double, pct_folds_below_wape_threshold double")
    return DC.decide(p, segments, errors, 0.08).select("product_id", "confianza_prediccion", "requiere_revision", "apto_automatizacion", "recomendacion_decision")


@query("j12_catalogue_cascade")
def catalogue_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with slips matched to the catalogue by rungs."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 3 == 1, F.lower("p_name")).otherwise(F.concat(F.lit("PT:"), F.col("p_name"))).alias("producto"))
    return MT.cascade(names, part.select(F.col("p_partkey").alias("catalog_id"), F.col("p_name").alias("product_name")))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue items: family:name path, size in grams and a code, as names are written in catalogues; ten letters tell the makers apart."""
    part = table(spark, sf_dir, "part")
    packs = F.element_at(F.array(*(F.lit(p) for p in ("FUNDA", "FRASCO", "BOTELLA", "DOYPACK"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    made = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 10), "0123456789", "GHIJKLMNOP")
    called = F.concat_ws(" ", F.upper("p_name"), F.upper(made), packs, F.concat((F.col("p_partkey") % 50 * 10 + 10).cast("string"), F.lit("GRS")))
    code = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" ("), (F.col("p_partkey") % 700 + 1000).cast("string"), F.lit(")"))).otherwise("")
    return part.select(F.col("p_partkey").alias("catalog_id"), F.concat(called, code).alias("product_name"), F.concat("p_type", F.lit(":"), called).alias("item_path"))


def _written(catalogue: DataFrame) -> DataFrame:
    """Names as they are written in sales: other order of words, slips, left-out words, another pack."""
    k, name = F.col("catalog_id") % 7, F.col("product_name")
    words = F.split(name, " ")
    wrong = F.concat(F.substring(name, 1, 4), F.lit("X"), F.expr("substring(product_name, 6)"))
    said = F.when(k == 0, name).when(k == 1, F.concat(F.lit("PT:"), F.lower(name))).when(k == 2, F.array_join(F.reverse(words), " ")).when(k == 3, wrong).when(k == 4, F.array_join(F.slice(words, 2, 20), " "))
    return catalogue.select(said.when(k == 5, F.concat(wrong, F.lit(" CAJA"))).otherwise(F.concat(F.lit("OTRO "), F.array_join(F.slice(words, 1, 2), " "))).alias("producto"))


@query("j13_match_ladder")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as sales write them against the catalogue of parts, by the long ladder."""
    catalogue = _catalogue(spark, sf_dir)
    return MT.ladder(_written(catalogue), catalogue, item="item_path")


@query("j15_closest_names")
def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short ladder: equal names, leaves and codes of one id, then the closest spelling of 0.88 or more."""
    catalogue = _catalogue(spark, sf_dir)
    return MT.short_ladder(_written(catalogue), catalogue, item="item_path")


@query("c16_leaf_items", "SELECT DISTINCT p_type || ':' || p_brand AS item FROM part")
def leaf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of family and family:brand items the ones no other item extends."""
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_type").alias("item")).union(part.select(F.concat("p_type", F.lit(":"), "p_brand"))).distinct()
    return MT.leaf_items(items, "item")


@query("d16_model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-fold temporal cross-validation of six models on brand months; selection never sees the test months."""
    features = written(FC.prepared(P.complete_grid(monthly_panel(spark, sf_dir))), "features")
    return BT.compare_models(features, FC.active_features(features), trees=20, depth=7)[0]


@query("d19_recursive_forecast")
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three months ahead, predictions feeding the next month's lags."""
    panel = P.complete_grid(monthly_panel(spark, sf_dir))
    features = FC.prepared(panel)
    columns = ["lag_1", "lag_12", "rolling_mean_3", "rolling_mean_12", "month_sin", "month_cos"]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    model = FC.fit(FC.trainable(features), FC.models()["linear"], columns)
    return text_month(FC.forecast(panel, model, 3))


@query("x01_stream_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS inicio, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the events table as a stream into hourly windows, read back from the sink."""
    return S.run_to_table(spark, f"{sf_dir}/events.parquet", S.hourly).select(F.date_format("inicio", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "event_type", "n", "total")
