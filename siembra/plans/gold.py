"""Gold layer: sales, return and margin indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siembra.functions.numeric import below, bucket, capped, safe_ratio
from siembra.operators.panel import month_difference
from siembra.operators.relational import average_rank
from siembra.plans.registry import query
from siembra.sources.tables import SALES_SQL, money_sum, monthly_panel, panel_sql, sales, table


@query(
    "g02_executive_summary",
    f"""
WITH s AS ({SALES_SQL}), a AS (
  SELECT agency, anio, mes,
         CAST(SUM(CAST(total_venta AS DECIMAL(18,4))) AS DOUBLE) AS total_ventas,
         CAST(SUM(CAST(total_devolucion AS DECIMAL(18,4))) AS DOUBLE) AS total_devoluciones,
         CAST(SUM(CAST(total_venta - total_devolucion AS DECIMAL(18,4))) AS DOUBLE) AS total_neto,
         CAST(SUM(CAST(costo_venta AS DECIMAL(18,4))) AS DOUBLE) AS costo_total,
         COUNT(*) AS n_lineas
  FROM s GROUP BY agency, anio, mes)
SELECT agency, anio, mes, total_ventas, total_devoluciones, total_neto, costo_total, n_lineas,
       CASE WHEN n_lineas > 0 THEN total_neto / n_lineas ELSE 0.0 END AS ticket_promedio,
       least(CASE WHEN total_ventas > 0 THEN total_devoluciones / total_ventas * 100 ELSE 0.0 END, 100.0) AS pct_devolucion,
       CASE WHEN total_neto > 0 THEN (total_neto - costo_total) / total_neto * 100 ELSE 0.0 END AS pct_margen
FROM a
""",
)
def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agency by month: sales, returns, net, ticket, capped return share and margin share."""
    ratio = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    rows = (
        sales(spark, sf_dir)
        .groupBy("agency", "anio", "mes")
        .agg(
            money_sum("total_venta").alias("total_ventas"),
            money_sum("total_devolucion").alias("total_devoluciones"),
            money_sum(F.col("total_venta") - F.col("total_devolucion")).alias("total_neto"),
            money_sum("costo_venta").alias("costo_total"),
            F.count("*").alias("n_lineas"),
        )
    )
    return rows.withColumns(
        {
            "ticket_promedio": ratio(F.col("total_neto"), F.col("n_lineas")),
            "pct_devolucion": F.least(ratio(F.col("total_devoluciones"), F.col("total_ventas")) * 100, F.lit(100.0)),
            "pct_margen": ratio(F.col("total_neto") - F.col("costo_total"), F.col("total_neto")) * 100,
        }
    )


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0.0 END"


def dec(expression: str) -> str:
    return f"CAST(SUM(CAST({expression} AS DECIMAL(18,4))) AS DOUBLE)"


_SUMS = f"""{dec('total_venta')} AS total_venta, {dec('total_devolucion')} AS total_devolucion, {dec('cant_venta')} AS cant_venta,
 {dec('cant_devolucion')} AS cant_devolucion, {dec('costo_venta')} AS costo_venta, {dec('total_venta - total_devolucion')} AS total_neto"""


def _sums() -> list[F.Column]:
    columns = ("total_venta", "total_devolucion", "cant_venta", "cant_devolucion", "costo_venta")
    return [*(money_sum(c).alias(c) for c in columns), money_sum(F.col("total_venta") - F.col("total_devolucion")).alias("total_neto")]


@query(
    "g01_kpi_rollup",
    f"""
WITH a AS (SELECT agency, brand, anio, mes, {_SUMS} FROM ({SALES_SQL}) GROUP BY ALL),
r AS (SELECT *, {ratio('cant_devolucion', 'cant_venta')} AS tasa_cant, {ratio('total_devolucion', 'total_venta')} AS tasa_valor,
  CASE WHEN abs(total_neto) > 1e-9 THEN (total_neto - costo_venta) / total_neto * 100 ELSE 0.0 END AS margen FROM a)
SELECT agency, brand, anio, mes, total_venta, total_devolucion, cant_venta, cant_devolucion, costo_venta, total_neto,
  least(tasa_cant, 1.0) AS tasa_devolucion_cant, least(tasa_valor, 1.0) AS tasa_devolucion_valor, margen AS pct_margen,
  {ratio('total_venta', 'cant_venta')} AS precio_promedio,
  CASE WHEN tasa_valor >= 0.15 THEN 'CRITICO' WHEN tasa_valor >= 0.08 THEN 'ALTO' WHEN tasa_valor >= 0.03 THEN 'MEDIO' ELSE 'BAJO' END AS nivel_devolucion,
  CASE WHEN margen < 0 THEN 'NEGATIVA' WHEN margen < 15 THEN 'BAJA' WHEN margen < 30 THEN 'MEDIA' ELSE 'ALTA' END AS nivel_rentabilidad,
  total_devolucion > total_venta OR total_neto < 0 AS flag_outlier
FROM r
""",
)
def kpi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agency, brand and month: sums, capped return rates, margin, and their levels."""
    a = sales(spark, sf_dir).groupBy("agency", "brand", "anio", "mes").agg(*_sums())
    rate = safe_ratio(F.col("total_devolucion"), F.col("total_venta"))
    margin = F.when(F.abs("total_neto") > 1e-9, (F.col("total_neto") - F.col("costo_venta")) / F.col("total_neto") * 100).otherwise(0.0)
    return a.withColumns({
        "tasa_devolucion_cant": capped(safe_ratio(F.col("cant_devolucion"), F.col("cant_venta")), 1.0),
        "tasa_devolucion_valor": capped(rate, 1.0),
        "pct_margen": margin,
        "precio_promedio": safe_ratio(F.col("total_venta"), F.col("cant_venta")),
        "nivel_devolucion": bucket(rate, [(0.15, "CRITICO"), (0.08, "ALTO"), (0.03, "MEDIO")], "BAJO"),
        "nivel_rentabilidad": below(margin, [(0, "NEGATIVA"), (15, "BAJA"), (30, "MEDIA")], "ALTA"),
        "flag_outlier": (F.col("total_devolucion") > F.col("total_venta")) | (F.col("total_neto") < 0),
    })


def _metrics_sql(key: str) -> str:
    return f"""
WITH a AS (SELECT {key}, COUNT(*) AS cant_venta, {dec('total_venta')} AS total_ventas, {dec('total_devolucion')} AS total_devolucion,
  {dec('total_venta - total_devolucion')} AS total_neto, {dec('costo_venta')} AS total_costo FROM ({SALES_SQL}) GROUP BY {key})
SELECT *, {ratio('total_neto', 'cant_venta')} AS ticket_promedio, least({ratio('total_devolucion', 'total_ventas')} * 100, 100.0) AS tasa_devolucion,
  CASE WHEN total_neto > 0 THEN (total_neto - total_costo) / total_neto ELSE 0.0 END * 100 AS ratio_rentabilidad FROM a
"""


def _metrics(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """``cant_venta`` counts lines, so the ticket is net over lines."""
    a = sales(spark, sf_dir, key, "total_venta", "total_devolucion", "costo_venta").groupBy(key).agg(F.count("*").alias("cant_venta"), money_sum("total_venta").alias("total_ventas"), money_sum("total_devolucion").alias("total_devolucion"), money_sum(F.col("total_venta") - F.col("total_devolucion")).alias("total_neto"), money_sum("costo_venta").alias("total_costo"))
    return a.withColumns({
        "ticket_promedio": safe_ratio(F.col("total_neto"), F.col("cant_venta")),
        "tasa_devolucion": capped(safe_ratio(F.col("total_devolucion"), F.col("total_ventas")) * 100, 100.0),
        "ratio_rentabilidad": safe_ratio(F.col("total_neto") - F.col("total_costo"), F.col("total_neto")) * 100,
    })


@query("g03_agency_metrics", _metrics_sql("agency"))
def agency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "agency")


@query("g04_product_metrics", _metrics_sql("product_id"))
def product_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "product_id")


@query(
    "g05_commercial_indicators",
    f"""
WITH s AS ({SALES_SQL}),
t AS (SELECT anio, mes, brand, family, segment, {dec('qty')} AS cantidad, {dec('value')} AS neto, COUNT(DISTINCT order_id) AS transacciones, 'transaccional' AS origen FROM s WHERE anio >= 1998 GROUP BY ALL),
h AS (SELECT anio, mes, brand, family, CAST(NULL AS VARCHAR) AS segment, {dec('qty')} AS cantidad, {dec('value')} AS neto, CAST(0 AS BIGINT) AS transacciones, 'historico' AS origen FROM s GROUP BY anio, mes, brand, family)
SELECT * FROM t UNION ALL SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.anio = h.anio AND t.mes = h.mes)
""",
)
def commercial_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactional months with distinct orders, and history for the months they lack."""
    s = sales(spark, sf_dir, "anio", "mes", "brand", "family", "segment", "qty", "value", "order_id")
    t = s.where("anio >= 1998").groupBy("anio", "mes", "brand", "family", "segment").agg(money_sum("qty").alias("cantidad"), money_sum("value").alias("neto"), F.countDistinct("order_id").alias("transacciones")).withColumn("origen", F.lit("transaccional"))
    h = s.groupBy("anio", "mes", "brand", "family").agg(money_sum("qty").alias("cantidad"), money_sum("value").alias("neto")).withColumns({"origen": F.lit("historico"), "transacciones": F.lit(0).cast("long")})
    return t.unionByName(h.join(t.select("anio", "mes").distinct(), ["anio", "mes"], "left_anti"), allowMissingColumns=True)


@query(
    "g12_seasonal_products",
    f"""
WITH p AS ({panel_sql('product_id')}),
m AS (SELECT product_id, COUNT(DISTINCT CASE WHEN target_qty > 0 THEN month(periodo) END) AS meses_activos, SUM(target_qty) AS total,
  string_agg(DISTINCT CASE WHEN target_qty > 0 THEN lpad(CAST(month(periodo) AS VARCHAR), 2, '0') END, ',' ORDER BY CASE WHEN target_qty > 0 THEN lpad(CAST(month(periodo) AS VARCHAR), 2, '0') END) AS meses,
  COUNT(*) FILTER (target_qty > 0) / COUNT(*) AS share FROM p GROUP BY product_id)
SELECT product_id, meses_activos, CAST(total AS DOUBLE) AS total, meses, CAST(share AS DOUBLE) AS share FROM m WHERE meses_activos <= 10 AND total >= 100
""",
)
def seasonal_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that sell in few months of the year and in quantity."""
    active = F.col("target_qty") > 0
    month = F.lpad(F.month("periodo").cast("string"), 2, "0")
    return (
        monthly_panel(spark, sf_dir, "product_id")
        .groupBy("product_id")
        .agg(F.countDistinct(F.when(active, F.month("periodo"))).alias("meses_activos"), F.sum("target_qty").alias("total"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(active, month)))).alias("meses"), (F.count_if(active) / F.count("*")).alias("share"))
        .where("meses_activos <= 10 and total >= 100")
    )


@query(
    "g13_inactive_products",
    f"""
WITH p AS ({panel_sql('product_id')}), r AS (SELECT MAX(periodo) AS ref FROM p),
a AS (SELECT product_id, MAX(periodo) FILTER (target_qty > 0) AS ultima FROM p GROUP BY product_id),
d AS (SELECT product_id, ultima, CASE WHEN ultima IS NULL THEN 9999 ELSE (year(ref) * 12 + month(ref)) - (year(ultima) * 12 + month(ultima)) END AS meses FROM a, r)
SELECT product_id, CAST(ultima AS VARCHAR) AS ultima, CAST(meses AS INTEGER) AS meses_sin_actividad FROM d WHERE meses >= 12
""",
)
def inactive_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a sale for twelve months; 9999 if they never sold."""
    p = monthly_panel(spark, sf_dir, "product_id")
    ref = p.agg(F.max("periodo").alias("ref")).scalar()
    a = p.groupBy("product_id").agg(F.max(F.when(F.col("target_qty") > 0, F.col("periodo"))).alias("ultima"))
    return a.withColumn("meses_sin_actividad", F.when(F.col("ultima").isNull(), 9999).otherwise(month_difference(ref, F.col("ultima")))).where("meses_sin_actividad >= 12").withColumn("ultima", F.col("ultima").cast("string"))


@query(
    "g15_code_conflicts",
    """
WITH c AS (SELECT CAST(p_partkey % 500 AS VARCHAR) AS codigo, upper(p_name) AS nombre FROM part)
SELECT codigo, COUNT(DISTINCT nombre) AS nombres, array_to_string(list_slice(list_sort(list_distinct(list(nombre))), 1, 8), ' | ') AS lista,
  CASE WHEN COUNT(DISTINCT nombre) <= 3 THEN 'MERGE' ELSE 'SPLIT' END AS consejo
FROM c GROUP BY codigo HAVING COUNT(DISTINCT nombre) > 1
""",
)
def code_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that stand for several names, the first eight of them, and what to do."""
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).cast("string").alias("codigo"), F.upper("p_name").alias("nombre"))
    g = c.groupBy("codigo").agg(F.countDistinct("nombre").alias("nombres"), F.array_join(F.slice(F.array_sort(F.collect_set("nombre")), 1, 8), " | ").alias("lista")).where("nombres > 1")
    return g.withColumn("consejo", F.when(F.col("nombres") <= 3, "MERGE").otherwise("SPLIT"))


@query(
    "g18_quality_ratios",
    """
WITH q AS (SELECT COUNT(*) AS n, CAST(COUNT(*) FILTER (p_retailprice > 1500) AS DOUBLE) / COUNT(*) * 100 AS pct_precio, CAST(COUNT(*) FILTER (p_size > 45) AS DOUBLE) / COUNT(*) * 100 AS pct_tamano FROM part)
SELECT 'pct_precio' AS metric, false AS nunca, CASE WHEN pct_precio < 5 THEN 'PASS' WHEN pct_precio < 20 THEN 'WARNING' ELSE 'FAIL' END AS estado, pct_precio AS value FROM q
UNION ALL SELECT 'pct_tamano', false, CASE WHEN pct_tamano < 5 THEN 'PASS' WHEN pct_tamano < 20 THEN 'WARNING' ELSE 'FAIL' END, pct_tamano FROM q
""",
)
def quality_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of quality metrics with PASS, WARNING or FAIL."""
    part = table(spark, sf_dir, "part")
    q = part.agg((F.count_if(F.col("p_retailprice") > 1500) / F.count("*") * 100).alias("pct_precio"), (F.count_if(F.col("p_size") > 45) / F.count("*") * 100).alias("pct_tamano"))
    long = q.select(F.expr("stack(2, 'pct_precio', pct_precio, 'pct_tamano', pct_tamano) as (metric, value)"))
    return long.withColumns({"estado": below(F.col("value"), [(5, "PASS"), (20, "WARNING")], "FAIL"), "nunca": F.lit(False)})


@query(
    "g22_volatility",
    f"""
WITH p AS ({panel_sql()}), a AS (SELECT product_id, avg(target_qty) AS media, coalesce(stddev_samp(target_qty), 0) AS desviacion, COUNT(DISTINCT target_qty) AS distintos FROM p GROUP BY product_id)
SELECT product_id, round(media, 6) AS media, round(desviacion, 6) AS desviacion, round(CASE WHEN media > 0 THEN desviacion / media ELSE 0.0 END, 6) AS cv, distintos FROM a
""",
)
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = monthly_panel(spark, sf_dir).groupBy("product_id").agg(F.avg("target_qty").alias("m"), F.coalesce(F.stddev_samp("target_qty"), F.lit(0.0)).alias("s"), F.countDistinct("target_qty").alias("distintos"))
    return a.select("product_id", F.round("m", 6).alias("media"), F.round("s", 6).alias("desviacion"), F.round(safe_ratio(F.col("s"), F.col("m")), 6).alias("cv"), "distintos")


@query(
    "g26_compliance",
    """
WITH o AS (SELECT l_orderkey, SUM(l_quantity) AS planificada, SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS fabricada FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, planificada, fabricada, CASE WHEN planificada > 0 THEN fabricada / planificada * 100 ELSE 0.0 END AS pct FROM o)
SELECT isodow(o_orderdate) - 1 AS weekday, o_orderstatus AS estado, COUNT(*) AS ordenes, COUNT(*) FILTER (pct >= 95) AS optimas,
 COUNT(*) FILTER (pct < 50) AS criticas, CAST(SUM(CAST(planificada AS DECIMAL(18,2))) AS DOUBLE) AS planificada, CAST(SUM(CAST(fabricada AS DECIMAL(18,2))) AS DOUBLE) AS fabricada
FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
""",
)
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned against made quantities by weekday and order state, with compliance classes counted."""
    lines = table(spark, sf_dir, "lineitem")
    o = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("planificada"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("fabricada"))
    level = bucket(safe_ratio(F.col("fabricada"), F.col("planificada")) * 100, [(95, "OPTIMO"), (80, "ACEPTABLE"), (50, "DEFICIENTE")], "CRITICO")
    c = o.withColumn("nivel", level).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return c.groupBy(F.weekday("o_orderdate").cast("long").alias("weekday"), F.col("o_orderstatus").alias("estado")).agg(
        F.count("*").alias("ordenes"), F.count_if(F.col("nivel") == "OPTIMO").alias("optimas"), F.count_if(F.col("nivel") == "CRITICO").alias("criticas"),
        F.sum(F.col("planificada").cast("decimal(18,2)")).cast("double").alias("planificada"), F.sum(F.col("fabricada").cast("decimal(18,2)")).cast("double").alias("fabricada"),
    )


@query(
    "g39_participation",
    f"""
WITH c AS (SELECT customer_id, {dec('value')} AS total FROM ({SALES_SQL}) GROUP BY customer_id)
SELECT customer_id, total, total / CAST(SUM(CAST(total AS DECIMAL(20,4))) OVER () AS DOUBLE) * 100 AS participacion FROM c
""",
)
def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every customer in all sales; the total is one scalar."""
    c = sales(spark, sf_dir).groupBy("customer_id").agg(money_sum("value").alias("total"))
    whole = c.agg(F.sum(F.col("total").cast("decimal(20,4)")).cast("double").alias("t")).scalar()
    return c.withColumn("participacion", F.col("total") / whole * 100)


@query(
    "g38_coverage",
    f"""
SELECT anio, CAST(MIN(order_date) AS VARCHAR) AS desde, CAST(MAX(order_date) AS VARCHAR) AS hasta, array_to_string(list_sort(list_distinct(list(segment))), ', ') AS fuentes, COUNT(*) AS n FROM ({SALES_SQL}) GROUP BY anio
""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("anio").agg(F.min("order_date").cast("string").alias("desde"), F.max("order_date").cast("string").alias("hasta"), F.array_join(F.array_sort(F.collect_set("segment")), ", ").alias("fuentes"), F.count("*").alias("n"))


@query(
    "d26_pareto",
    f"""
WITH a AS (SELECT product_id, {dec('value')} AS total FROM ({SALES_SQL}) GROUP BY product_id),
c AS (SELECT product_id, total, CAST(SUM(CAST(total AS DECIMAL(20,4))) OVER (ORDER BY total DESC, product_id) AS DOUBLE) AS acumulado, CAST(SUM(CAST(total AS DECIMAL(20,4))) OVER () AS DOUBLE) AS todo FROM a)
SELECT product_id, total, acumulado / todo * 100 AS pct_acumulado, acumulado / todo * 100 <= 80 AS pareto_80 FROM c
""",
)
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by value with their cumulative share.

    The order is global, so cumulated values are built from ranges of the value: sums by range are
    combined first, and only the rows of one range are ordered together.
    """
    return cumulative_value(sales(spark, sf_dir, "product_id", "value").groupBy("product_id").agg(money_sum("value").alias("total")))


def cumulative_value(a: DataFrame) -> DataFrame:
    """(product_id, total, pct_acumulado, pareto_80) of totals by product; a missing total is 0."""
    a = a.withColumn("total", F.coalesce("total", F.lit(0.0)))
    exact = F.col("total").cast("decimal(20,4)")
    placed = a.withColumn("__range", F.floor(F.signum("total") * F.log2(F.abs("total") + 1) * 64))
    sums = placed.groupBy("__range").agg(F.sum(exact).alias("__n"))
    above = sums.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(30,4)")).alias("__above"))  # a few thousand ranges at most
    inside = F.sum(exact).over(Window.partitionBy("__range").orderBy(F.desc("total"), "product_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = a.agg(F.sum(exact).cast("double").alias("t")).scalar()
    share = (F.col("__above") + F.col("__inside")).cast("double") / whole * 100
    return placed.withColumn("__inside", inside).join(F.broadcast(above), "__range").select("product_id", "total", share.alias("pct_acumulado"), (share <= 80).alias("pareto_80"))


@query(
    "w11_average_rank",
    f"""
WITH a AS (SELECT agency, brand, {dec('cant_venta')} AS total FROM ({SALES_SQL}) GROUP BY ALL)
SELECT agency, brand, total, (rank() OVER (PARTITION BY agency ORDER BY total DESC) + (COUNT(*) OVER (PARTITION BY agency, total) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY agency) AS pct_rank FROM a
""",
)
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent rank of brands within an agency, ties at their mean."""
    a = sales(spark, sf_dir).groupBy("agency", "brand").agg(money_sum("cant_venta").alias("total"))
    return a.withColumn("pct_rank", average_rank(F.col("total"), ["agency"]) / F.count("*").over(Window.partitionBy("agency")))


@query(
    "w14_top_products",
    f"""
WITH a AS (SELECT agency, anio, mes, product_id, {dec('cant_venta')} AS total FROM ({SALES_SQL}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY agency, anio, mes ORDER BY total DESC, product_id) AS rn FROM a)
SELECT agency, anio, mes, product_id, total, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 40
""",
)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best products of every agency and month."""
    a = sales(spark, sf_dir).groupBy("agency", "anio", "mes", "product_id").agg(money_sum("cant_venta").alias("total"))
    return a.withColumn("rn", F.row_number().over(Window.partitionBy("agency", "anio", "mes").orderBy(F.desc("total"), "product_id"))).where("rn <= 40")


@query(
    "g43_inefficiency",
    f"""
WITH a AS (SELECT agency, brand, {dec('total_venta')} AS v, {dec('total_devolucion')} AS d, {dec('costo_venta')} AS c FROM ({SALES_SQL}) GROUP BY ALL),
s AS (SELECT agency, brand, 0.4 * least(CASE WHEN v > 0 THEN d / v ELSE 0.0 END, 1.0) + 0.3 * (1 - least(greatest(CASE WHEN v - d > 0 THEN (v - d - c) / (v - d) ELSE 0.0 END, 0.0), 1.0)) + 0.3 * (1 - least(greatest(CASE WHEN v > 0 THEN (v - d) / (v * 0.85) ELSE 0.0 END, 0.0), 1.0)) AS puntaje FROM a)
SELECT agency, brand, round(puntaje, 6) AS puntaje, round(puntaje - avg(puntaje) OVER (PARTITION BY brand), 6) AS desvio_marca FROM s
""",
)
def inefficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of returns, margin and attainment, and its distance from the brand's mean."""
    a = sales(spark, sf_dir).groupBy("agency", "brand").agg(money_sum("total_venta").alias("v"), money_sum("total_devolucion").alias("d"), money_sum("costo_venta").alias("c"))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    net = F.col("v") - F.col("d")
    score = 0.4 * F.least(safe_ratio(F.col("d"), F.col("v")), F.lit(1.0)) + 0.3 * (1 - clip(safe_ratio(net - F.col("c"), net))) + 0.3 * (1 - clip(F.when(F.col("v") > 0, net / (F.col("v") * 0.85)).otherwise(0.0)))
    s = a.withColumn("p", score)
    return s.select("agency", "brand", F.round("p", 6).alias("puntaje"), F.round(F.col("p") - F.avg("p").over(Window.partitionBy("brand")), 6).alias("desvio_marca"))
