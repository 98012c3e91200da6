"""Commercial queries: routing, consolidation, budgets, quality reports, segments, alerts, mart SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siembra.functions.numeric import lookup, safe_ratio
from siembra.operators import classify as K
from siembra.operators import commercial as C
from siembra.operators import metrics as ME
from siembra.operators import mining as M
from siembra.operators import panel as P
from siembra.plans.gold import dec
from siembra.plans.panels import _GRID, text_month
from siembra.plans.planning import _LAG, _baseline
from siembra.plans.registry import query
from siembra.sources.scratch import written
from siembra.sources.tables import SALES_SQL, money_sum, monthly_panel, panel_sql, sales, table


@query(
    "f04_document_routing",
    """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'NC DEV' WHEN 'A' THEN 'NC' ELSE 'FACTURA' END AS k, l_quantity AS q, -l_extendedprice AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 'FACTURA' THEN q ELSE 0 END AS cant_venta, CASE WHEN k = 'NC' THEN q ELSE 0 END AS cant_nc, CASE WHEN k = 'NC DEV' THEN abs(v) ELSE 0 END AS total_devolucion FROM d
""",
)
def document_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lookup(F.col("l_returnflag"), {"R": "NC DEV", "A": "NC", "N": "FACTURA"})
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("k"), F.col("l_quantity").alias("q"), (-F.col("l_extendedprice")).alias("v"))
    return C.route_documents(d, "k", "q", "v").select("l_orderkey", "l_linenumber", "cant_venta", "cant_nc", "total_devolucion")


@query(
    "f05_scale_repair",
    """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN l_quantity * 100 ELSE l_quantity END AS q, l_extendedprice AS v, l_extendedprice / l_quantity AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q >= 100 AND q % 100 = 0 AND p / (v / q) BETWEEN 80 AND 120 THEN q / 100 ELSE q END AS q, q >= 100 AND q % 100 = 0 AND p / (v / q) BETWEEN 80 AND 120 AS escala_corregida FROM l
""",
)
def scale_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), F.col("l_extendedprice").alias("v"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return C.repair_scale(d, "q", "v", "p").select("l_orderkey", "l_linenumber", "q", "escala_corregida")


@query(
    "g07_order_consolidation",
    "SELECT l_orderkey, COUNT(*) AS lineas, MAX(l_linenumber) AS ultimo_item, SUM(l_quantity) AS cantidad, CAST(MAX(l_shipdate) AS VARCHAR) AS ultima_fecha, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS primer_estado FROM lineitem GROUP BY l_orderkey",
)
def order_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: counts, sums, last date and the first line's label."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lineas"), F.max("l_linenumber").alias("ultimo_item"), F.sum("l_quantity").alias("cantidad"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("ultima_fecha"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("primer_estado"))


@query(
    "g10_mode",
    "SELECT p_brand, tipo FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, tipo) AS r FROM (SELECT p_brand, p_type AS tipo, COUNT(*) AS n FROM part GROUP BY p_brand, p_type)) WHERE r = 1",
)
def modal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.modal_labels(table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("tipo")), "p_brand", "tipo")


@query(
    "g19_quality_report",
    """
WITH v AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice - 1000 END AS v FROM lineitem),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM v),
d AS (SELECT CAST(SUM(n - 1) AS DOUBLE) AS d FROM (SELECT COUNT(*) AS n FROM v GROUP BY l_orderkey, l_partkey)),
f AS (SELECT CAST(COUNT(*) AS DOUBLE) AS filas, CAST(COUNT(*) FILTER (v IS NULL) AS DOUBLE) AS faltantes, CAST(COUNT(*) FILTER (v < 0) AS DOUBLE) AS negativos, CAST(COUNT(*) FILTER (v = 0) AS DOUBLE) AS ceros,
 CAST(COUNT(*) FILTER (v < a - (b - a) * 1.5 OR v > b + (b - a) * 1.5) AS DOUBLE) AS atipicos, round(MAX(v / m), 6) AS razon_maxima FROM v, q)
SELECT regla, valor FROM (SELECT filas, faltantes, negativos, ceros, atipicos, razon_maxima, d AS duplicados FROM f, d) UNPIVOT (valor FOR regla IN (filas, faltantes, negativos, ceros, atipicos, razon_maxima, duplicados))
""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") - 1000)
    r = C.quality_report(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", v.alias("v")), ["l_orderkey", "l_partkey"], "v")
    return r.withColumn("valor", F.round("valor", 6))


@query(
    "g28_z_alerts",
    f"""
WITH a AS (SELECT agency, mes, {dec('value')} AS v FROM ({SALES_SQL}) GROUP BY ALL), s AS (SELECT mes, avg(v) AS m, stddev_samp(v) AS s FROM a GROUP BY mes)
SELECT agency, mes, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 6) AS z, abs(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END) > 2 AS alerta FROM a JOIN s USING (mes)
""",
)
def z_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sales(spark, sf_dir).groupBy("agency", "mes").agg(money_sum("value").alias("v"))
    return M.z_scores(a, ["v"], ["mes"]).select("agency", "mes", F.round("z_v", 6).alias("z"), (F.abs("z_v") > 2).alias("alerta"))


@query(
    "g33_volume_segments",
    f"""{_LAG},
e AS (SELECT product_id, CAST(sum(y) AS DOUBLE) AS y, CAST(sum(abs(y - f)) AS DOUBLE) AS e FROM t GROUP BY product_id),
c AS (SELECT *, sum(CAST(y AS DECIMAL(24,6))) OVER (ORDER BY y DESC, product_id) / (SELECT sum(CAST(y AS DECIMAL(24,6))) FROM e) AS a FROM e)
SELECT 'top_20' AS segmento, COUNT(*) AS productos, round(sum(e) / sum(y), 6) AS wape FROM c WHERE a <= 0.2 UNION ALL SELECT 'top_50', COUNT(*), round(sum(e) / sum(y), 6) FROM c WHERE a <= 0.5 UNION ALL SELECT 'top_80', COUNT(*), round(sum(e) / sum(y), 6) FROM c WHERE a <= 0.8""",
)
def volume_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAPE of the products that make up 20, 50 and 80 % of the volume."""
    e = _baseline(spark, sf_dir).groupBy("product_id").agg(F.sum("y").alias("y"), F.sum(F.abs(F.col("y") - F.col("f"))).alias("e"))
    c = C.cumulative_segments(e, "product_id", "y")
    s = c.withColumn("segmento", F.explode(F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in ("top_20", "top_50", "top_80"))), lambda x: x.isNotNull())))
    return s.groupBy("segmento").agg(F.count("*").alias("productos"), F.round(F.sum("e") / F.sum("y"), 6).alias("wape"))


@query(
    "g34_walk_forward_summary",
    f"""{_LAG},
w AS (SELECT periodo, CASE WHEN length(product_id) % 2 = 0 THEN 'par' ELSE 'impar' END AS segmento, sum(abs(y - f)) / sum(y) AS wape FROM t GROUP BY ALL)
SELECT segmento, round(avg(wape), 6) AS mean_wape, round(stddev_samp(wape), 6) AS std_wape, round(min(wape), 6) AS min_wape, round(max(wape), 6) AS max_wape, avg(CAST(wape <= 0.1 AS DOUBLE)) AS pct_folds_below_wape_threshold, COUNT(DISTINCT periodo) AS folds,
 avg(wape) <= 0.1 AND stddev_samp(wape) <= 0.03 AND avg(CAST(wape <= 0.1 AS DOUBLE)) >= 0.67 AS segmento_apto_automatizacion FROM w GROUP BY segmento""",
)
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.length("product_id") % 2 == 0, "par").otherwise("impar")
    w = _baseline(spark, sf_dir).groupBy("periodo", segment.alias("segmento")).agg(*ME.error_metrics("y", "f"))
    return ME.walk_forward_summary(w, "periodo").withColumns({c: F.round(c, 6) for c in ("mean_wape", "std_wape", "min_wape", "max_wape")})


@query(
    "g41_uncertainty",
    f"""{_LAG},
a AS (SELECT product_id, CASE WHEN length(product_id) % 2 = 0 THEN 'PT' ELSE 'PP' END AS tipo, abs(y - f) / y AS ape FROM t WHERE y > 0)
SELECT tipo, round(median(ape), 6) AS mediana, round(least(greatest(median(ape), 0.15), 0.85), 6) AS factor FROM a GROUP BY tipo""",
)
def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    tipo = F.when(F.length("product_id") % 2 == 0, "PT").otherwise("PP")
    a = _baseline(spark, sf_dir).where("y > 0").groupBy(tipo.alias("tipo")).agg(F.median(F.abs(F.col("y") - F.col("f")) / F.col("y")).alias("m"))
    return a.select("tipo", F.round("m", 6).alias("mediana"), F.round(F.least(F.greatest("m", F.lit(0.15)), F.lit(0.85)), 6).alias("factor"))


_MART = """
SELECT n.n_name AS agencia, CASE WHEN n.n_regionkey IN (0, 1) THEN 'NORTE' ELSE 'SUR' END AS zona, COUNT(DISTINCT o.o_orderkey) AS pedidos,
       COUNT(DISTINCT o.o_custkey) AS clientes, ROUND(SUM(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) / NULLIF(COUNT(*), 0) * 100, 2) AS pct_cerrados
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, CASE WHEN n.n_regionkey IN (0, 1) THEN 'NORTE' ELSE 'SUR' END
"""


@query("g42_mart_sql", _MART)
def mart_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart in SQL text over views: Spark and the oracle run the same statement."""
    return spark.sql(_MART.replace("orders o", "{orders} o").replace("customer c", "{customer} c").replace("nation n", "{nation} n"), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))


@query(
    "g44_budget",
    f"""
WITH a AS (SELECT agency, anio, {dec('total_venta')} AS v, {dec('total_devolucion')} AS d, {dec('total_venta - total_devolucion')} AS n FROM ({SALES_SQL}) GROUP BY ALL),
p AS (SELECT *, n / 0.85 * CASE WHEN length(agency) % 2 = 0 THEN 1.1 ELSE 0.95 END * CASE WHEN v > 0 AND d / v > 0.05 THEN 1 + d / v ELSE 1.0 END AS presupuesto FROM a)
SELECT agency, anio, round(presupuesto, 4) AS presupuesto, round(CASE WHEN presupuesto > 0 THEN n / presupuesto * 100 ELSE 0 END, 6) AS cumplimiento,
 CASE WHEN CASE WHEN presupuesto > 0 THEN n / presupuesto * 100 ELSE 0 END >= 95 THEN 'VERDE' WHEN CASE WHEN presupuesto > 0 THEN n / presupuesto * 100 ELSE 0 END >= 80 THEN 'AMARILLO' ELSE 'ROJO' END AS semaforo FROM p
""",
)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sales(spark, sf_dir).groupBy("agency", "anio").agg(money_sum("total_venta").alias("v"), money_sum("total_devolucion").alias("d"), money_sum(F.col("total_venta") - F.col("total_devolucion")).alias("n"))
    zone = F.when(F.length("agency") % 2 == 0, 1.1).otherwise(0.95)
    return C.budget(a, "n", "d", "v", zone).select("agency", "anio", F.round("presupuesto", 4).alias("presupuesto"), F.round("cumplimiento", 6).alias("cumplimiento"), "semaforo")


@query(
    "g47_rule_statistics",
    f"""
WITH b AS (SELECT DISTINCT order_id, family FROM ({SALES_SQL})), n AS (SELECT COUNT(DISTINCT order_id) AS n FROM b), s AS (SELECT family, COUNT(*) AS c FROM b GROUP BY family),
p AS (SELECT x.family AS a, y.family AS b, COUNT(*) AS k FROM b x JOIN b y ON x.order_id = y.order_id AND x.family < y.family GROUP BY ALL)
SELECT COUNT(*) AS pares, round(MAX(k * n / (sa.c * sb.c)), 6) AS lift_maximo, COUNT(*) FILTER (k * n / (sa.c * sb.c) > 1) AS lift_sobre_uno FROM p JOIN s sa ON sa.family = a JOIN s sb ON sb.family = p.b, n
""",
)
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = written(sales(spark, sf_dir, "order_id", "family").distinct(), "pairs")
    counts = M.pair_counts(pairs, "order_id", "family")
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    return counts.agg(F.count("*").alias("pares"), F.round(F.max(lift), 6).alias("lift_maximo"), F.count_if(lift > 1).alias("lift_sobre_uno"))


@query(
    "l03_largest_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(
    "l05_best_month",
    f"SELECT product_id, CAST(arg_max(periodo, (target_qty, periodo)) AS VARCHAR) AS mejor_mes, MAX(target_qty) AS maximo FROM ({panel_sql()}) GROUP BY product_id",
)
def best_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_panel(spark, sf_dir).groupBy("product_id").agg(F.max_by("periodo", F.struct("target_qty", "periodo")).cast("string").alias("mejor_mes"), F.max("target_qty").alias("maximo"))


@query(
    "r10_item_jaccard",
    f"""
WITH b AS (SELECT agency, list_distinct(list(brand)) AS s FROM ({SALES_SQL}) WHERE qty > 49 AND mes = 1 GROUP BY agency)
SELECT x.agency AS a, y.agency AS b, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) AS jaccard FROM b x JOIN b y ON x.agency < y.agency WHERE len(list_intersect(x.s, y.s)) > 0
""",
)
def item_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the brand sets of agencies: pairs come from the brands they share, sizes from the sets."""
    items = sales(spark, sf_dir).where("qty > 49 and mes = 1").select("agency", "brand").distinct()
    sizes = items.groupBy("agency").agg(F.count("*").alias("n"))
    x, y = (items.select("brand", F.col("agency").alias(n)) for n in ("a", "b"))
    both = x.join(y, "brand").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = both.join(sizes.select(F.col("agency").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("agency").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


@query(
    "w19_next_period",
    f"WITH p AS ({panel_sql()}) SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, CAST(MIN(periodo) OVER (PARTITION BY product_id) AS VARCHAR) AS primero, periodo = MAX(periodo) OVER (PARTITION BY product_id) AS es_ultimo FROM p",
)
def group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("product_id")
    p = monthly_panel(spark, sf_dir).withColumns({"primero": F.min("periodo").over(w).cast("string"), "es_ultimo": F.col("periodo") == F.max("periodo").over(w)})
    return text_month(p).select("product_id", "periodo", "primero", "es_ultimo")


@query(
    "d29_capped_demand",
    f"""
WITH p AS ({panel_sql('product_id')}), {_GRID}, q AS (SELECT product_id, quantile_cont(target_qty, 0.995) AS tope FROM g GROUP BY product_id)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, least(target_qty, tope) AS cantidad, target_qty > tope AS recortada FROM g JOIN q USING (product_id)
""",
)
def capped_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months above the 99.5 % quantile of their product are cut to it."""
    g = P.complete_grid(monthly_panel(spark, sf_dir, "product_id"))
    q = g.groupBy("product_id").agg(F.percentile("target_qty", F.lit(0.995)).alias("tope"))
    return text_month(g.join(q, "product_id").select("product_id", "periodo", F.least("target_qty", "tope").alias("cantidad"), (F.col("target_qty") > F.col("tope")).alias("recortada")))


@query("m11_return_risk")
def return_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of a high return rate next month, learned on earlier periods and scored on the last fifth."""
    a = sales(spark, sf_dir, "brand", "periodo", "total_venta", "total_devolucion", "qty").groupBy(F.col("brand").alias("product_id"), "periodo").agg(money_sum("total_venta").alias("v"), money_sum("total_devolucion").alias("d"), money_sum("qty").alias("q"))
    a = a.withColumn("rate", safe_ratio(F.col("d"), F.col("v")))
    w = Window.partitionBy("product_id").orderBy("periodo")
    f = a.withColumns({"label": (F.lead("rate").over(w) > 0.5).cast("double"), "lag_rate": F.coalesce(F.lag("rate").over(w), F.lit(0.0)), "log_v": F.log1p("v")}).where("label is not null")
    f = written(f, "risk")  # a row a brand and month: the forest reads it many times
    train, test = K.temporal_split(f)
    model = K.fit_risk(train, ["rate", "lag_rate", "log_v", "q"], "label")
    return text_month(K.score_risk(test, model).select("product_id", "periodo", "probabilidad", "riesgo", "label"))
