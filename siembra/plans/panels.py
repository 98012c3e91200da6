"""Panel queries: grids, lags, point-in-time profiles, name versions, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siembra.operators import panel as P
from siembra.plans.registry import query
from siembra.sources.tables import SALES_SQL, monthly_panel, panel_sql, sales, table

_GRID = """
first AS (SELECT product_id, MIN(periodo) AS desde FROM p WHERE target_qty > 0 GROUP BY product_id),
grid AS (SELECT product_id, CAST(unnest(generate_series(desde, (SELECT MAX(periodo) FROM p), INTERVAL 1 MONTH)) AS DATE) AS periodo FROM first),
g AS (SELECT grid.product_id, grid.periodo, coalesce(p.target_qty, 0.0) AS target_qty, CAST(p.product_id IS NOT NULL AS INTEGER) AS monthly_observed_flag
  FROM grid LEFT JOIN p ON p.product_id = grid.product_id AND p.periodo = grid.periodo)"""


def text_month(df: DataFrame) -> DataFrame:
    return df.withColumn("periodo", F.col("periodo").cast("string"))


@query("r04_grid_completion", f"WITH p AS ({panel_sql('product_id')}), {_GRID} SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, target_qty, monthly_observed_flag FROM g")
def grid_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_month(P.complete_grid(monthly_panel(spark, sf_dir, "product_id")))


@query(
    "r05_own_grid",
    f"""
WITH p AS ({panel_sql('product_id')}), s AS (SELECT product_id, MIN(periodo) FILTER (target_qty > 0) AS desde, MAX(periodo) AS hasta FROM p GROUP BY product_id),
g AS (SELECT product_id, CAST(unnest(generate_series(desde, hasta, INTERVAL 1 MONTH)) AS DATE) AS periodo FROM s WHERE desde IS NOT NULL)
SELECT g.product_id, COUNT(*) AS meses, COUNT(p.product_id) AS observados FROM g LEFT JOIN p USING (product_id, periodo) GROUP BY g.product_id
""",
)
def own_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.complete_grid(monthly_panel(spark, sf_dir, "product_id"), to_global_end=False)
    return g.groupBy("product_id").agg(F.count("*").alias("meses"), F.sum("monthly_observed_flag").alias("observados"))


@query(
    "w01_lag_features",
    f"""
WITH p AS ({panel_sql()}), {_GRID}
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, target_qty, lag(target_qty, 1) OVER w AS lag_1, lag(target_qty, 12) OVER w AS lag_12,
 avg(target_qty) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean_3, avg(target_qty) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_mean_12,
 max(target_qty) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_max_12,
 CAST(coalesce(sum(CAST(target_qty > 0 AS INTEGER)) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS nonzero_6,
 max(target_qty) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expanding_max, CAST(row_number() OVER w - 1 AS INTEGER) AS months_since_first
FROM g WINDOW w AS (PARTITION BY product_id ORDER BY periodo)
""",
)
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, rolling and expanding values that see earlier months only."""
    df = P.lag_features(P.complete_grid(monthly_panel(spark, sf_dir)))
    return text_month(df).select("product_id", "periodo", "target_qty", "lag_1", "lag_12", "rolling_mean_3", "rolling_mean_12", "rolling_max_12", "nonzero_6", "expanding_max", "months_since_first")


@query(
    "w02_next_target",
    f"WITH p AS ({panel_sql()}), {_GRID} SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, lead(target_qty) OVER w AS target_next, CAST(lead(periodo) OVER w AS VARCHAR) AS next_period FROM g WINDOW w AS (PARTITION BY product_id ORDER BY periodo)",
)
def next_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.next_month_target(P.complete_grid(monthly_panel(spark, sf_dir)))
    return text_month(df).select("product_id", "periodo", "target_next", F.col("next_period").cast("string").alias("next_period"))


_PROFILE = """
h AS (SELECT a.product_id, a.periodo, b.periodo AS antes, b.target_qty AS q FROM g a LEFT JOIN g b ON b.product_id = a.product_id AND b.periodo < a.periodo AND b.target_qty > 0),
last AS (SELECT product_id, periodo, MAX(antes) AS ultima, CAST(SUM(q) AS DOUBLE) AS total FROM h GROUP BY ALL),
bym AS (SELECT product_id, periodo, month(antes) AS m, SUM(q) AS s FROM h WHERE antes IS NOT NULL GROUP BY ALL),
top AS (SELECT product_id, periodo, CAST(SUM(s) AS DOUBLE) AS t3, string_agg(CAST(m AS VARCHAR), ',' ORDER BY s DESC, m) AS meses FROM (SELECT *, row_number() OVER (PARTITION BY product_id, periodo ORDER BY s DESC, m) AS r FROM bym) WHERE r <= 3 GROUP BY ALL),
byy AS (SELECT product_id, periodo, COUNT(*) AS anios, median(n) AS med FROM (SELECT product_id, periodo, year(antes) AS y, COUNT(DISTINCT month(antes)) AS n FROM h WHERE antes IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


@query(
    "w09_point_in_time_profile",
    f"""
WITH p AS ({panel_sql()}), {_GRID}, {_PROFILE}
SELECT l.product_id, CAST(l.periodo AS VARCHAR) AS periodo, CASE WHEN ultima >= l.periodo - INTERVAL 12 MONTH THEN 'activo' ELSE 'inactivo' END AS estado_producto,
 coalesce(anios >= 2 AND (t3 / total >= 0.6 OR med <= 4), false) AS es_estacional, coalesce(meses, '') AS meses_estacionales_num, CAST(ultima AS VARCHAR) AS ultima_actividad
FROM last l LEFT JOIN top USING (product_id, periodo) LEFT JOIN byy USING (product_id, periodo)
""",
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and seasonality of each month from earlier months only."""
    df = P.point_in_time_profile(P.complete_grid(monthly_panel(spark, sf_dir)))
    return text_month(df).select("product_id", "periodo", "estado_producto", "es_estacional", "meses_estacionales_num", F.col("ultima_actividad").cast("string").alias("ultima_actividad"))


@query(
    "g21_product_summary",
    f"""
WITH p AS ({panel_sql('product_id')}), {_GRID}, r AS (SELECT MAX(periodo) AS ref FROM g),
a AS (SELECT product_id, CAST(SUM(target_qty) AS DOUBLE) AS total_qty, COUNT(*) AS meses_en_serie, MIN(periodo) FILTER (target_qty > 0) AS primera, MAX(periodo) FILTER (target_qty > 0) AS ultima, COUNT(*) FILTER (target_qty > 0) AS meses_con_actividad FROM g GROUP BY product_id),
m AS (SELECT product_id, month(periodo) AS m, SUM(target_qty) AS s FROM g WHERE target_qty > 0 GROUP BY ALL),
t AS (SELECT product_id, CAST(SUM(s) AS DOUBLE) AS t3, string_agg(CAST(m AS VARCHAR), ',' ORDER BY s DESC, m) AS meses FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY s DESC, m) AS k FROM m) WHERE k <= 3 GROUP BY product_id),
y AS (SELECT product_id, COUNT(*) AS anios, median(n) AS med FROM (SELECT product_id, year(periodo) AS y, COUNT(DISTINCT month(periodo)) AS n FROM g WHERE target_qty > 0 GROUP BY ALL) GROUP BY product_id)
SELECT a.product_id, total_qty, meses_en_serie, CAST(primera AS VARCHAR) AS primera_actividad, CAST(ultima AS VARCHAR) AS ultima_actividad, meses_con_actividad,
 CASE WHEN ultima >= ref - INTERVAL 11 MONTH THEN 'activo' ELSE 'inactivo' END AS estado_producto, coalesce(t3, 0.0) / total_qty AS share_top_3_meses, meses AS meses_estacionales_num,
 med AS mediana_meses_activos_por_anio, anios >= 2 AND (t3 / total_qty >= 0.6 OR med <= 4) AS es_estacional
FROM a CROSS JOIN r JOIN t USING (product_id) JOIN y USING (product_id)
""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity, state and seasonality of products over all their history."""
    df = P.product_summary(P.complete_grid(monthly_panel(spark, sf_dir, "product_id")))
    return df.withColumns({c: F.col(c).cast("string") for c in ("primera_actividad", "ultima_actividad")})


@query(
    "w18_name_versions",
    """
WITH e AS (SELECT user_id % 200 AS codigo, CAST(date_trunc('day', ts) AS DATE) AS periodo, event_type AS nombre FROM events),
c AS (SELECT codigo, periodo, nombre, COUNT(*) AS n FROM e WHERE nombre <> '' GROUP BY ALL),
d AS (SELECT codigo, periodo, nombre FROM (SELECT *, row_number() OVER (PARTITION BY codigo, periodo ORDER BY n DESC, nombre) AS r FROM c) WHERE r = 1),
f AS (SELECT *, CASE WHEN nombre IS DISTINCT FROM lag(nombre) OVER (PARTITION BY codigo ORDER BY periodo) THEN 1 ELSE 0 END AS nuevo FROM d),
v AS (SELECT *, SUM(nuevo) OVER (PARTITION BY codigo ORDER BY periodo) AS version FROM f),
o AS (SELECT codigo, CAST(version AS BIGINT) AS version, MIN(nombre) AS nombre, MIN(periodo) AS d, MAX(periodo) AS h FROM v GROUP BY codigo, version)
SELECT codigo, version, nombre, CAST(d AS VARCHAR) AS vigente_desde, CAST(h AS VARCHAR) AS vigente_hasta, codigo || '_V' || version AS sku_id, version = MAX(version) OVER (PARTITION BY codigo) AS activo FROM o
""",
)
def name_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of the dominant name of a code."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("codigo"), F.to_date("ts").alias("periodo"), F.col("event_type").alias("nombre"))
    return P.name_versions(e, "codigo", "periodo", "nombre").withColumns({c: F.col(c).cast("string") for c in ("vigente_desde", "vigente_hasta")})


@query(
    "w21_intermittency",
    f"""
WITH p AS ({panel_sql('product_id')}), {_GRID}, n AS (SELECT product_id, target_qty, row_number() OVER (PARTITION BY product_id ORDER BY periodo) AS k FROM g),
d AS (SELECT product_id, k - lag(k) OVER (PARTITION BY product_id ORDER BY k) AS gap FROM n WHERE target_qty > 0),
a AS (SELECT product_id, avg(gap) AS mean_gap, COUNT(*) AS positive_months FROM d GROUP BY product_id)
SELECT product_id, COUNT(*) AS months, avg(CAST(target_qty <= 0 AS DOUBLE)) AS zero_share, any_value(mean_gap) AS mean_gap, any_value(positive_months) AS positive_months, any_value(positive_months) < 6 AS low_history FROM n JOIN a USING (product_id) GROUP BY product_id
""",
)
def intermittency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.intermittency(P.complete_grid(monthly_panel(spark, sf_dir, "product_id")))


@query(
    "w22_imputation",
    f"""
WITH p AS ({panel_sql()}), m AS (SELECT product_id, periodo, CASE WHEN month(periodo) % 5 = 0 THEN NULL ELSE target_qty END AS v FROM p),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY periodo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(v IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY periodo ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM m)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, coalesce(v, a, b, 0.0) AS v, CASE WHEN v IS NOT NULL THEN 'observado' WHEN a IS NOT NULL THEN 'previo' WHEN b IS NOT NULL THEN 'posterior' ELSE 'mediana' END AS imputacion FROM f
""",
)
def imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing months from the one before, else the one after, else the median."""
    m = monthly_panel(spark, sf_dir).select("product_id", "periodo", F.when(F.month("periodo") % 5 != 0, F.col("target_qty")).alias("v"))
    return text_month(P.impute(m, "product_id", "periodo", "v"))


@query(
    "w20_scale_jumps",
    f"""
WITH p AS ({panel_sql('product_id')}), j AS (SELECT product_id, periodo, target_qty, lag(target_qty) OVER (PARTITION BY product_id ORDER BY periodo) AS a FROM p)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, target_qty, target_qty / a AS salto FROM j WHERE a > 0 AND (target_qty / a > 8 OR target_qty / a < 0.125)
""",
)
def scale_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_month(P.scale_jumps(monthly_panel(spark, sf_dir, "product_id"), "product_id", "periodo", "target_qty"))


@query(
    "f20_iqr_outliers",
    f"""
WITH s AS (SELECT brand, order_id, line_no, value FROM ({SALES_SQL})), q AS (SELECT brand, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY brand),
b AS (SELECT s.*, q1 - (q3 - q1) * 0.3 AS lo, q3 + (q3 - q1) * 0.3 AS hi FROM s JOIN q USING (brand))
SELECT brand, order_id, line_no, value < lo OR value > hi AS es_outlier, round(greatest(least(value, hi), greatest(lo, 0.0)), 4) AS recortado FROM b
""",
)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beyond the quartile bounds of their brand, and what they are clipped to."""
    s = sales(spark, sf_dir).select("brand", "order_id", "line_no", "value")
    return P.iqr_flags(s, "value", ["brand"], 0.3).select("brand", "order_id", "line_no", "es_outlier", F.round("recortado", 4).alias("recortado"))
