"""Silver and gold queries: sign routing, repairs, levels, conflicts, PP panel, benchmarks, alerts, dashboard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siembra.functions.numeric import safe_ratio
from siembra.operators import silver as S
from siembra.operators.relational import left_pairs
from siembra.plans.gold import dec
from siembra.plans.registry import query
from siembra.sources.tables import SALES_SQL, money_sum, monthly_panel, panel_sql, sales, table


@query(
    "f03_sign_routing",
    """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, CASE WHEN l_returnflag = 'A' THEN -l_extendedprice ELSE l_extendedprice END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q < 0 OR v < 0 THEN 0 ELSE q END AS cant_venta, CASE WHEN q < 0 OR v < 0 THEN 0 ELSE v END AS total_venta, CASE WHEN q < 0 OR v < 0 THEN abs(q) ELSE 0 END AS cant_devolucion, CASE WHEN q < 0 OR v < 0 THEN abs(v) ELSE 0 END AS total_devolucion FROM d
""",
)
def sign_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    v = F.when(F.col("l_returnflag") == "A", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), v.alias("v"))
    return S.route_signs(d, "q", "v").drop("q", "v")


@query(
    "p11_margin_repair",
    """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS total_neto, l_extendedprice * 0.6::DOUBLE AS costo_venta,
  l_linenumber = 1 AS was, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN 1e14::DOUBLE WHEN l_orderkey % 5 = 2 THEN 'nan'::DOUBLE ELSE l_extendedprice * 0.3::DOUBLE END AS r FROM lineitem),
x AS (SELECT *, r IS NULL OR isnan(r) OR abs(r) >= 1e13 AS bad, was OR r IS NULL OR isnan(r) OR abs(r) >= 1e13 AS flag_outlier FROM d), y AS (SELECT *, CASE WHEN bad THEN total_neto - costo_venta ELSE r END AS rentabilidad FROM x)
SELECT l_orderkey, l_linenumber, rentabilidad, flag_outlier, CASE WHEN abs(total_neto) > 1e-9 THEN rentabilidad / total_neto * 100 ELSE 0 END AS prc_rentabilidad FROM y
""",
)
def margin_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins that can't be; first lines come flagged already."""
    part = F.col("l_orderkey") % 5
    r = F.when(part == 0, None).when(part == 1, 1e14).when(part == 2, float("nan")).otherwise(F.col("l_extendedprice") * 0.3)
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("total_neto"), (F.col("l_extendedprice") * 0.6).alias("costo_venta"), r.alias("rentabilidad"), (F.col("l_linenumber") == 1).alias("flag_outlier"))
    return S.repair_margin(d).drop("total_neto", "costo_venta")


_RATES = f"SELECT agency, anio, {dec('cant_venta')} AS v, {dec('cant_devolucion')} AS d, {dec('total_venta')} AS tv, {dec('costo_venta')} AS c FROM ({SALES_SQL}) GROUP BY agency, anio"


def _rates(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy(*keys).agg(money_sum("cant_venta").alias("v"), money_sum("cant_devolucion").alias("d"), money_sum("total_venta").alias("tv"), money_sum("costo_venta").alias("c"))


@query(
    "f12_stage_levels",
    f"""
WITH r AS ({_RATES}), x AS (SELECT agency, anio, CASE WHEN v > 0 THEN d / v * 100 ELSE 0 END AS tasa, CASE WHEN tv > 0 THEN (tv - c) / tv * 100 ELSE 0 END AS margen FROM r)
SELECT agency, anio, tasa, margen, CASE WHEN tasa = 0 THEN 'SIN_DEVOLUCION' WHEN tasa < 5 THEN 'NORMAL' WHEN tasa < 15 THEN 'ELEVADA' ELSE 'CRITICA' END AS nivel_devolucion,
  CASE WHEN margen < 0 THEN 'PERDIDA' WHEN margen < 20 THEN 'BAJA' WHEN margen < 35 THEN 'NORMAL' ELSE 'ALTA' END AS nivel_rentabilidad FROM x
""",
)
def stage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rates(spark, sf_dir, "agency", "anio")
    tasa = F.when(F.col("v") > 0, F.col("d") / F.col("v") * 100).otherwise(0.0)
    margen = F.when(F.col("tv") > 0, (F.col("tv") - F.col("c")) / F.col("tv") * 100).otherwise(0.0)
    x = r.select("agency", "anio", tasa.alias("tasa"), margen.alias("margen"))
    return x.withColumns({"nivel_devolucion": S.return_level(F.col("tasa")), "nivel_rentabilidad": S.margin_level(F.col("margen"))})


_DISPATCH = "SELECT o_custkey, CAST(SUM(l_quantity) AS DOUBLE) AS pedida, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS DOUBLE) AS despachada, COUNT(DISTINCT l_orderkey) AS ordenes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"


@query(
    "g25_client_compliance",
    f"""
WITH r AS ({_DISPATCH}), x AS (SELECT *, CASE WHEN pedida > 0 THEN despachada / pedida * 100 ELSE 0 END AS tasa FROM r)
SELECT o_custkey, pedida, despachada, ordenes, tasa, CASE WHEN tasa >= 95 THEN 'CUMPLE' WHEN tasa >= 80 THEN 'PARCIAL' WHEN tasa > 0 THEN 'BAJO' ELSE 'SIN_DESPACHO' END AS clase FROM x
""",
)
def client_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered and dispatched quantities of every client, their rate and its class (F-11)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sent = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)
    r = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey").agg(F.sum("l_quantity").alias("pedida"), F.sum(sent).alias("despachada"), F.countDistinct("l_orderkey").alias("ordenes"))
    tasa = F.when(F.col("pedida") > 0, F.col("despachada") / F.col("pedida") * 100).otherwise(0.0)
    return r.withColumn("tasa", tasa).withColumn("clase", S.dispatch_class(F.col("tasa")))


@query(
    "f21_alert_sense",
    f"""
WITH r AS ({_RATES}), x AS (SELECT agency, anio, CASE WHEN tv > 0 THEN (tv - c) / tv * 100 ELSE 0 END AS m, CASE WHEN v > 0 THEN d / v * 100 ELSE 0 END AS t FROM r)
SELECT agency, anio, CASE WHEN m > 30 AND t < 10 THEN 'POSITIVA' WHEN t >= 15 THEN 'NEGATIVA' ELSE 'MIXTA' END AS sentido, coalesce(CASE WHEN t >= 15 THEN 'ALTA_DEVOLUCION' END, 'PATRON_INUSUAL') AS razon FROM x
""",
)
def alert_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rates(spark, sf_dir, "agency", "anio")
    m, t = F.when(F.col("tv") > 0, (F.col("tv") - F.col("c")) / F.col("tv") * 100).otherwise(0.0), F.when(F.col("v") > 0, F.col("d") / F.col("v") * 100).otherwise(0.0)
    return r.select("agency", "anio", S.alert_sense(m, t).alias("sentido"), F.coalesce(F.when(t >= 15, "ALTA_DEVOLUCION"), F.lit("PATRON_INUSUAL")).alias("razon"))


_PP = """
SELECT CAST(l_partkey % 200 AS VARCHAR) AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS periodo, CAST(SUM(l_quantity) AS DOUBLE) AS q_fabricada,
  COUNT(DISTINCT l_suppkey) AS lotes, COUNT(DISTINCT l_orderkey) AS ordenes FROM lineitem GROUP BY ALL
"""


def _pp_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).cast("string").alias("product_id"), F.trunc(F.to_date("l_shipdate"), "MM").alias("periodo"), "l_quantity", "l_suppkey", "l_orderkey")
    return d.groupBy("product_id", "periodo").agg(F.sum("l_quantity").alias("q_fabricada"), F.countDistinct("l_suppkey").alias("lotes"), F.countDistinct("l_orderkey").alias("ordenes"))


@query("g09_production_panel", f"SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, q_fabricada, lotes, ordenes, ordenes = 1 AS orden_unica FROM ({_PP})")
def production_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly production: quantity, distinct lots and orders, and whether a single order stands behind it."""
    return _pp_panel(spark, sf_dir).withColumns({"periodo": F.col("periodo").cast("string"), "orden_unica": F.col("ordenes") == 1})


_MADE = """
SELECT CAST(l_partkey % 200 AS VARCHAR) AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS periodo, CAST(SUM(l_quantity) AS DOUBLE) AS fabricada,
  CAST(SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS planificada, COUNT(DISTINCT l_orderkey) AS ordenes FROM lineitem GROUP BY ALL
"""


@query(
    "f22_suspicious_outliers",
    f"""
WITH p AS ({_MADE}), q AS (
 SELECT product_id, quantile_cont(fabricada, [0.25, 0.75, 0.995]) AS f, quantile_cont(planificada, [0.25, 0.75, 0.995]) AS g FROM p GROUP BY product_id),
j AS (SELECT p.*, greatest(f[2] + 3 * (f[2] - f[1]), f[3], 0) AS bf, greatest(g[2] + 3 * (g[2] - g[1]), g[3], 0) AS bp FROM p JOIN q USING (product_id)),
s AS (SELECT *, fabricada > bf AND NOT (planificada > 0 OR ordenes >= 2) AS sf, planificada > bp AND ordenes <= 1 AS sp FROM j)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, fabricada AS fabricada_raw, planificada AS planificada_raw, round(CASE WHEN sf THEN bf ELSE fabricada END, 6) AS fabricada, round(CASE WHEN sp THEN bp ELSE planificada END, 6) AS planificada,
 fabricada > bf AS extremo_fabricada, planificada > bp AS extremo_planificada, sf AS sospechoso_fabricada, sp AS sospechoso_planificada,
 CASE WHEN sf AND sp THEN 'cap_ambas' WHEN sf THEN 'cap_fabricada' WHEN sp THEN 'cap_planificada' ELSE 'none' END AS tratamiento FROM s
""",
)
def suspicious_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of made and planned quantities are capped only where no plan or order stands behind them."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).cast("string").alias("product_id"), F.trunc(F.to_date("l_shipdate"), "MM").alias("periodo"), "l_quantity", "l_returnflag", "l_orderkey")
    planned = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)
    p = d.groupBy("product_id", "periodo").agg(F.sum("l_quantity").alias("fabricada"), F.sum(planned).alias("planificada"), F.countDistinct("l_orderkey").alias("ordenes"))
    capped = S.cap_suspicious(p, ["product_id"], "fabricada", "planificada", "ordenes").drop("ordenes")
    return capped.withColumns({"periodo": F.col("periodo").cast("string"), "fabricada": F.round("fabricada", 6), "planificada": F.round("planificada", 6)})


@query(
    "g11_first_non_null",
    "SELECT c_mktsegment, arg_min(c_name, c_custkey) FILTER (c_acctbal > 0) AS primero FROM customer GROUP BY c_mktsegment",
)
def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of a segment that isn't missing, in the order of the key; a balance of 0 or less counts as missing."""
    c = table(spark, sf_dir, "customer").withColumn("nombre", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return c.groupBy("c_mktsegment").agg(F.min_by("nombre", F.when(F.col("nombre").isNotNull(), F.col("c_custkey"))).alias("primero"))


_EAN = "SELECT lpad(CAST(7860000000000 + p_partkey % 700 AS VARCHAR), CASE WHEN p_partkey % 9 = 0 THEN 12 ELSE 13 END, '0') AS ean, upper(trim(p_name)) AS nombre, p_brand, p_type FROM part"


def _ean(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_partkey") % 9 == 0, 12).otherwise(13)
    ean = F.call_function("lpad", (F.lit(7860000000000) + F.col("p_partkey") % 700).cast("string"), size, F.lit("0"))
    return table(spark, sf_dir, "part").select(ean.alias("ean"), F.upper(F.trim("p_name")).alias("nombre"), "p_brand", "p_type")


@query("g14_ean_conflicts", f"WITH e AS ({_EAN}) SELECT ean, COUNT(DISTINCT nombre) AS nombres, COUNT(*) AS filas FROM e WHERE regexp_full_match(ean, '[0-9]{{13}}') GROUP BY ean HAVING COUNT(DISTINCT nombre) > 1")
def ean_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid codes of thirteen digits that stand for more than one name."""
    return _ean(spark, sf_dir).where(F.col("ean").rlike("^[0-9]{13}$")).groupBy("ean").agg(F.countDistinct("nombre").alias("nombres"), F.count("*").alias("filas")).where("nombres > 1")


@query("g16_catalogue_conflicts", f"WITH e AS ({_EAN}) SELECT ean, COUNT(DISTINCT p_brand) AS marcas, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS lista FROM e GROUP BY ean HAVING COUNT(DISTINCT p_brand) > 1")
def catalogue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ean(spark, sf_dir).groupBy("ean").agg(F.array_sort(F.collect_set("p_brand")).alias("m"))
    return e.where(F.size("m") > 1).select("ean", F.size("m").cast("long").alias("marcas"), F.array_join("m", " | ").alias("lista"))


@query("g17_state_summary", "SELECT o_orderstatus AS estado, COUNT(*) AS filas, COUNT(DISTINCT coalesce(nullif(trim(o_orderpriority), ''), 'SIN')) AS prioridades, COUNT(DISTINCT o_custkey) AS clientes FROM orders GROUP BY o_orderstatus")
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.lit("SIN"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("estado")).agg(F.count("*").alias("filas"), F.countDistinct(kind).alias("prioridades"), F.countDistinct("o_custkey").alias("clientes"))


@query(
    "g23_frame_quality",
    f"""
WITH p AS ({panel_sql('brand')}) SELECT COUNT(*) AS filas, COUNT(DISTINCT product_id) AS productos, COUNT(DISTINCT periodo) AS periodos, COUNT(*) - COUNT(DISTINCT (product_id, periodo)) AS claves_repetidas, COUNT(*) FILTER (target_qty IS NULL) AS nulos, COUNT(*) FILTER (target_qty = 0) AS ceros FROM p
""",
)
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly_panel(spark, sf_dir)
    return p.agg(F.count("*").alias("filas"), F.countDistinct("product_id").alias("productos"), F.countDistinct("periodo").alias("periodos"), (F.count("*") - F.countDistinct("product_id", "periodo")).alias("claves_repetidas"), F.count_if(F.col("target_qty").isNull()).alias("nulos"), F.count_if(F.col("target_qty") == 0).alias("ceros"))


@query(
    "g24_commercial_kpis",
    f"SELECT agency, brand, anio, mes, {dec('value')} AS ventas, COUNT(DISTINCT customer_id) AS clientes, COUNT(DISTINCT order_id) AS ordenes, {dec('value')} / COUNT(DISTINCT order_id) AS ticket FROM ({SALES_SQL}) GROUP BY agency, brand, anio, mes",
)
def commercial_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sales(spark, sf_dir).groupBy("agency", "brand", "anio", "mes").agg(money_sum("value").alias("ventas"), F.countDistinct("customer_id").alias("clientes"), F.countDistinct("order_id").alias("ordenes"))
    return g.withColumn("ticket", F.col("ventas") / F.col("ordenes"))


@query(
    "w12_integer_rank",
    f"WITH a AS (SELECT agency, brand, round({dec('cant_venta')} / 500) AS total FROM ({SALES_SQL}) GROUP BY ALL) SELECT agency, brand, total, CAST(floor(rank() OVER (PARTITION BY agency ORDER BY total DESC) + (COUNT(*) OVER (PARTITION BY agency, total) - 1) / 2.0) AS INTEGER) AS puesto FROM a",
)
def integer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of brands within an agency, cut to whole numbers."""
    a = sales(spark, sf_dir).groupBy("agency", "brand").agg(F.round(money_sum("cant_venta") / 500).alias("total"))
    ties = F.count("*").over(Window.partitionBy("agency", "total"))
    return a.withColumn("puesto", F.floor(F.rank().over(Window.partitionBy("agency").orderBy(F.desc("total"))) + (ties - 1) / 2.0).cast("int"))


@query("w23_latest_rows", f"WITH p AS ({panel_sql('brand')}) SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, target_qty FROM p QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY periodo DESC) = 1")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_row(monthly_panel(spark, sf_dir), "product_id", "periodo").withColumn("periodo", F.col("periodo").cast("string"))


@query(
    "c31_lot_bands",
    f"""
WITH p AS ({panel_sql('brand')}), h AS (SELECT product_id, periodo, target_qty, CASE WHEN right(product_id, 1) IN ('1', '3', '5') THEN 'PT' ELSE 'PP' END AS tipo, lag(target_qty) OVER w AS l1,
  stddev_samp(target_qty) OVER (PARTITION BY product_id ORDER BY periodo ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sd FROM p WINDOW w AS (PARTITION BY product_id ORDER BY periodo)),
x AS (SELECT *, ceil(greatest(target_qty, 0)) AS q, least(greatest(coalesce(CASE WHEN month(periodo) % 3 > 0 THEN month(periodo) / 10.0::DOUBLE END, 0.25::DOUBLE), 0.10::DOUBLE), 1.0::DOUBLE) AS f, floor(greatest(coalesce(l1, 0), 0) * 0.2::DOUBLE) AS inv FROM h),
s AS (SELECT *, ceil(greatest(greatest(coalesce(sd, 0), 0) * 0.5::DOUBLE, q * 0.1::DOUBLE)) AS seg, floor(q * (1 - f)) AS mn, ceil(q * (1 + f)) AS mx FROM x),
n AS (SELECT *, CASE WHEN tipo = 'PT' THEN greatest(q + seg - inv, 0) ELSE q END AS need, CASE WHEN tipo = 'PT' THEN greatest(mn + floor(seg * 0.7::DOUBLE) - ceil(inv * 1.1::DOUBLE), 0) ELSE mn END AS low, CASE WHEN tipo = 'PT' THEN mx + ceil(seg * 1.2::DOUBLE) ELSE mx END AS high FROM s),
b AS (SELECT *, ceil(need / 5) * 5 AS best FROM n)
SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, tipo, CAST(best AS DOUBLE) AS qty_recomendada, CAST(least(floor(low / 5) * 5, best) AS DOUBLE) AS qty_min_recomendada, CAST(ceil(greatest(best, need, high) / 5) * 5 AS DOUBLE) AS qty_max_recomendada FROM b
""",
)
def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations and bands in lots of five (C-31, D-23); brands that end in 1, 3 or 5 are finished products."""
    w = Window.partitionBy("product_id").orderBy("periodo")
    p = monthly_panel(spark, sf_dir).withColumns({
        "f": F.when(F.month("periodo") % 3 > 0, F.month("periodo") / 10.0), "tipo": F.when(F.substring("product_id", -1, 1).isin("1", "3", "5"), "PT").otherwise("PP"),
        "l1": F.lag("target_qty").over(w), "sd": F.stddev_samp("target_qty").over(w.rowsBetween(-3, -1)),
    })
    return S.lot_bands(p, "target_qty", "f", kind="tipo", lag="l1", spread="sd").select("product_id", F.col("periodo").cast("string").alias("periodo"), "tipo", "qty_recomendada", "qty_min_recomendada", "qty_max_recomendada")


@query(
    "j08_function_keys",
    "SELECT e.p_partkey AS a, p.p_partkey AS b FROM part e LEFT JOIN part p ON e.p_name = p.p_name AND upper(e.p_type) = upper(p.p_type) AND p.p_partkey % 2 = 0",
)
def function_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join on a name and an upper-cased type; names that repeat give several rows."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("n"), F.upper("p_type").alias("t"))
    p = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("b"), F.col("p_name").alias("n"), F.upper("p_type").alias("t"))
    return left_pairs(e, p, ["n", "t"], "a", "b")


@query(
    "j18_exogenous",
    f"""
WITH p AS ({panel_sql('brand')}), m AS (SELECT DISTINCT periodo FROM p),
c AS (SELECT periodo, CASE WHEN month(periodo) % 4 = 0 THEN (30 + month(periodo)) / 2 ELSE month(periodo) END AS dias_habiles FROM m),
x AS (SELECT product_id, periodo, CASE WHEN month(periodo) % 2 = 0 THEN (target_qty * 2 + target_qty) / 2 ELSE target_qty END AS pedidos FROM p WHERE year(periodo) % 2 = 0)
SELECT p.product_id, CAST(p.periodo AS VARCHAR) AS periodo, p.target_qty, CAST(c.dias_habiles AS DOUBLE) AS dias_habiles, coalesce(x.pedidos, 0.0) AS pedidos FROM p LEFT JOIN c USING (periodo) LEFT JOIN x ON p.product_id = x.product_id AND p.periodo = x.periodo
""",
)
def exogenous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar rows for all sources with own rows beside them in every fourth month; product rows of the source, of all and of another one."""
    p = monthly_panel(spark, sf_dir)
    months = p.select("periodo").distinct()
    general = months.select(F.lit("ALL").alias("source_type"), "periodo", F.month("periodo").alias("dias_habiles"))
    own = months.where(F.month("periodo") % 4 == 0).select(F.lit("PT").alias("source_type"), "periodo", F.lit(30).alias("dias_habiles"))
    even = p.where(F.year("periodo") % 2 == 0)
    product = even.select(F.lit("").alias("source_type"), "product_id", "periodo", F.col("target_qty").alias("pedidos")).unionByName(even.where(F.month("periodo") % 2 == 0).select(F.lit("PT").alias("source_type"), "product_id", "periodo", (F.col("target_qty") * 2).alias("pedidos")))
    product = product.unionByName(p.select(F.lit("PP").alias("source_type"), "product_id", "periodo", F.lit(-1.0).alias("pedidos")))
    return S.exogenous(p, general.unionByName(own), product, "PT").select("product_id", F.col("periodo").cast("string").alias("periodo"), "target_qty", "dias_habiles", "pedidos")


@query("j19_next_period", f"WITH p AS ({panel_sql('brand')}) SELECT a.product_id, CAST(a.periodo AS VARCHAR) AS periodo, a.target_qty, b.target_qty AS target_qty_t1 FROM p a LEFT JOIN p b ON a.product_id = b.product_id AND b.periodo = a.periodo + INTERVAL 1 MONTH")
def following_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.next_period(monthly_panel(spark, sf_dir), "product_id", "periodo", "target_qty").withColumn("periodo", F.col("periodo").cast("string"))


_PLAN = "SELECT o_orderpriority AS tipo, o_custkey % 50 AS producto, CAST(date_trunc('month', l_shipdate) AS DATE) AS periodo, CAST(SUM(l_quantity) AS DOUBLE) AS plan, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS DOUBLE) AS hecho FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus", F.trunc(F.to_date("l_shipdate"), "MM").alias("periodo"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tipo"), (F.col("o_custkey") % 50).alias("producto"))
    made = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("tipo", "producto", "periodo").agg(F.sum("l_quantity").alias("plan"), F.sum(made).alias("hecho"))


@query(
    "g32_plan_benchmark",
    f"WITH p AS ({_PLAN}), m AS (SELECT tipo, periodo, SUM(plan) AS plan, SUM(hecho) AS hecho FROM p GROUP BY ALL) SELECT tipo, COUNT(*) AS meses, CASE WHEN SUM(abs(hecho)) = 0 THEN 0 ELSE SUM(abs(hecho - plan)) / SUM(abs(hecho)) END AS wape FROM m GROUP BY tipo",
)
def plan_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly plan against what was made, by type: the error a model has to beat."""
    m = _plan(spark, sf_dir).groupBy("tipo", "periodo").agg(F.sum("plan").alias("plan"), F.sum("hecho").alias("hecho"))
    return m.groupBy("tipo").agg(F.count("*").alias("meses"), S.wape(F.col("hecho"), F.col("plan")).alias("wape"))


@query(
    "g35_plan_and_model",
    f"""
WITH p AS ({_PLAN}), l AS (SELECT *, coalesce(lag(hecho) OVER (PARTITION BY tipo, producto ORDER BY periodo), 0) AS modelo FROM p),
g AS (SELECT tipo, CASE WHEN GROUPING(tipo) = 1 THEN 'global' ELSE 'tipo' END AS nivel, SUM(abs(hecho - plan)) AS ep, SUM(abs(hecho - modelo)) AS em, SUM(abs(hecho)) AS h, COUNT(DISTINCT plan) AS planes FROM l GROUP BY GROUPING SETS ((), (tipo)))
SELECT nivel, coalesce(tipo, 'todos') AS grupo, CASE WHEN h = 0 THEN 0 ELSE ep / h END AS wape_plan, CASE WHEN h = 0 THEN 0 ELSE em / h END AS wape_modelo, CASE WHEN ep = 0 THEN 0 ELSE (ep - em) / ep END AS ganancia, planes > 1 AS plan_informativo FROM g
""",
)
def plan_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan and last month's value against what was made, over all and by type, in one grouping."""
    last = F.coalesce(F.lag("hecho").over(Window.partitionBy("tipo", "producto").orderBy("periodo")), F.lit(0.0))
    e = _plan(spark, sf_dir).withColumn("modelo", last)
    sums = [F.sum(F.abs(F.col("hecho") - F.col("plan"))).alias("ep"), F.sum(F.abs(F.col("hecho") - F.col("modelo"))).alias("em"), F.sum(F.abs("hecho")).alias("h"), F.countDistinct("plan").alias("planes")]
    g = e.groupingSets([[], [F.col("tipo")]], F.col("tipo")).agg(F.grouping("tipo").alias("todo"), *sums)
    return g.select(F.when(F.col("todo") == 1, "global").otherwise("tipo").alias("nivel"), F.coalesce("tipo", F.lit("todos")).alias("grupo"), safe_ratio(F.col("ep"), F.col("h")).alias("wape_plan"), safe_ratio(F.col("em"), F.col("h")).alias("wape_modelo"), safe_ratio(F.col("ep") - F.col("em"), F.col("ep")).alias("ganancia"), (F.col("planes") > 1).alias("plan_informativo"))


_ERRORS = "round(SUM(abs(hecho - plan)) / nullif(SUM(abs(hecho)), 0), 6) AS wape, round(SUM(plan - hecho) / nullif(SUM(abs(hecho)), 0) * 100, 6) AS bias_pct, round(AVG(CASE WHEN abs(hecho) + abs(plan) > 0 THEN 2 * abs(hecho - plan) / (abs(hecho) + abs(plan)) ELSE 0 END), 6) AS smape, round(AVG(abs(hecho - plan)), 6) AS mae, round(sqrt(AVG((hecho - plan) * (hecho - plan))), 6) AS rmse"


@query(
    "g37_pilot_errors",
    f"""
WITH p AS ({_PLAN}), v AS (SELECT tipo, producto FROM (SELECT tipo, producto, row_number() OVER (PARTITION BY tipo ORDER BY SUM(hecho) DESC, producto) AS r FROM p GROUP BY tipo, producto) WHERE r <= 10)
SELECT 'piloto' AS segmento, tipo AS valor, COUNT(*) AS filas, COUNT(DISTINCT producto) AS productos, {_ERRORS} FROM p JOIN v USING (tipo, producto) GROUP BY tipo
UNION ALL SELECT 'tipo', tipo, COUNT(*), COUNT(DISTINCT producto), {_ERRORS} FROM p GROUP BY tipo
UNION ALL SELECT 'categoria', CAST(producto % 7 AS VARCHAR), COUNT(*), COUNT(DISTINCT producto), {_ERRORS} FROM p WHERE (producto % 7 <> 6 OR month(periodo) = 1 AND producto = 6 AND year(periodo) < 1994) GROUP BY producto % 7 HAVING COUNT(*) >= 8
""",
)
def pilot_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors against what was made: pilots (a type's ten products of most volume), types, and categories of eight rows or more."""
    p = _plan(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("tipo").orderBy(F.desc("t"), "producto"))
    top = p.groupBy("tipo", "producto").agg(F.sum("hecho").alias("t")).withColumn("r", rank).where("r <= 10").select("tipo", "producto")
    few = (F.col("producto") % 7 != 6) | ((F.month("periodo") == 1) & (F.col("producto") == 6) & (F.year("periodo") < 1994))
    rows = p.join(top, ["tipo", "producto"], "left_semi").select(F.lit("piloto").alias("segmento"), F.col("tipo").alias("valor"), "producto", "plan", "hecho")
    rows = rows.unionByName(p.select(F.lit("tipo").alias("segmento"), F.col("tipo").alias("valor"), "producto", "plan", "hecho"))
    rows = rows.unionByName(p.where(few).select(F.lit("categoria").alias("segmento"), (F.col("producto") % 7).cast("string").alias("valor"), "producto", "plan", "hecho"))
    return S.segment_errors(rows, ["segmento", "valor"], "producto", "hecho", "plan").where("segmento != 'categoria' OR filas >= 8")


@query(
    "g46_dashboard_kpis",
    f"""
WITH r AS (SELECT agency, {dec('total_venta')} AS total_venta, {dec('total_devolucion')} AS total_devolucion, {dec('cant_venta')} - {dec('cant_devolucion')} AS cant_neto, {dec('costo_venta')} AS c FROM ({SALES_SQL}) GROUP BY agency),
n AS (SELECT *, total_venta - total_devolucion AS total_neto FROM r)
SELECT agency, total_venta, total_devolucion, total_neto, cant_neto, coalesce(total_neto / nullif(cant_neto, 0), 0) AS ticket_promedio, coalesce(total_devolucion / nullif(total_venta, 0) * 100, 0) AS tasa_devolucion,
 coalesce((total_neto - c) / nullif(total_neto, 0) * 100, 0) AS rentabilidad_promedio, CAST(COUNT(*) OVER () AS BIGINT) AS agencias FROM n
""",
)
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by agency and ratios made from the sums: returns by value, margin over net sales, ticket; a zero below the line gives 0."""
    r = _rates(spark, sf_dir, "agency").join(sales(spark, sf_dir).groupBy("agency").agg(money_sum("total_devolucion").alias("total_devolucion")), "agency")
    n = r.agg(F.count("*").alias("n")).scalar()
    r = r.select("agency", F.col("tv").alias("total_venta"), "total_devolucion", (F.col("tv") - F.col("total_devolucion")).alias("total_neto"), (F.col("v") - F.col("d")).alias("cant_neto"), "c")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(F.col(b), F.lit(0.0))), F.lit(0.0))
    return r.select("agency", "total_venta", "total_devolucion", "total_neto", "cant_neto", ratio(F.col("total_neto"), "cant_neto").alias("ticket_promedio"), (ratio(F.col("total_devolucion"), "total_venta") * 100).alias("tasa_devolucion"), (ratio(F.col("total_neto") - F.col("c"), "total_neto") * 100).alias("rentabilidad_promedio"), n.alias("agencias"))


@query(
    "g48_trends",
    f"""
WITH s AS (SELECT * FROM ({SALES_SQL})), t AS (SELECT CAST(product_id AS VARCHAR) AS clave, {dec('value')} AS total FROM s GROUP BY product_id ORDER BY total DESC, clave LIMIT 10)
SELECT 'agencia' AS vista, agency AS clave, '' AS periodo, {dec('value')} AS total FROM s GROUP BY agency UNION ALL SELECT 'producto', clave, '', total FROM t
UNION ALL SELECT 'mes', agency, CAST(periodo AS VARCHAR), {dec('value')} FROM s GROUP BY agency, periodo
""",
)
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measure by agency, for the ten best products, and by month and agency."""
    s = sales(spark, sf_dir)
    by_month = s.groupBy("agency", "periodo").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("t"))
    months = by_month.select(F.lit("mes").alias("vista"), F.col("agency").alias("clave"), F.col("periodo").cast("string").alias("periodo"), F.col("t").cast("double").alias("total"))
    agencies = by_month.groupBy("agency").agg(F.sum("t").cast("double").alias("total")).select(F.lit("agencia").alias("vista"), F.col("agency").alias("clave"), F.lit("").alias("periodo"), "total")
    top = s.groupBy(F.col("product_id").cast("string").alias("clave")).agg(money_sum("value").alias("total")).orderBy(F.desc("total"), "clave").limit(10).select(F.lit("producto").alias("vista"), "clave", F.lit("").alias("periodo"), "total")
    return agencies.unionByName(top).unionByName(months)


@query(
    "d24_input_summary",
    f"""
WITH a AS ({panel_sql('brand')}), b AS (SELECT product_id, periodo, q_fabricada AS target_qty FROM ({_PP}))
SELECT 'pt_mensual_model' AS tabla, COUNT(*) AS filas, COUNT(DISTINCT product_id) AS productos, CAST(MIN(periodo) AS VARCHAR) AS desde, CAST(MAX(periodo) AS VARCHAR) AS hasta, CAST(SUM(CAST(target_qty AS DECIMAL(18,4))) AS DOUBLE) AS total FROM a
UNION ALL SELECT 'pp_mensual_model', COUNT(*), COUNT(DISTINCT product_id), CAST(MIN(periodo) AS VARCHAR), CAST(MAX(periodo) AS VARCHAR), CAST(SUM(CAST(target_qty AS DECIMAL(18,4))) AS DOUBLE) FROM b
""",
)
def input_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, products, span and total of the two model panels."""
    return S.summarise(monthly_panel(spark, sf_dir), "pt_mensual_model").unionByName(S.summarise(_pp_panel(spark, sf_dir).withColumnRenamed("q_fabricada", "target_qty"), "pp_mensual_model"))


@query(
    "s21_typed_scan",
    """
SELECT CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%STEEL%' THEN 'METAL' WHEN p_type LIKE 'PROMO%' THEN 'PROMO' ELSE 'OTRO' END AS categoria, COUNT(*) AS filas,
  CAST(SUM(CAST(coalesce(TRY_CAST(nullif(trim(CASE WHEN p_partkey % 6 = 0 THEN ' ' WHEN p_partkey % 6 = 1 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END), '') AS DOUBLE), 0) AS DECIMAL(18,4))) AS DOUBLE) AS total FROM part GROUP BY 1
""",
)
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns read as numbers where they are some, categories by patterns."""
    raw = F.when(F.col("p_partkey") % 6 == 0, " ").when(F.col("p_partkey") % 6 == 1, "n/a").otherwise(F.col("p_size").cast("string"))
    kind = F.when(F.col("p_type").like("%BRASS%") | F.col("p_type").like("%STEEL%"), "METAL").when(F.col("p_type").like("PROMO%"), "PROMO").otherwise("OTRO")
    number = F.coalesce(F.nullif(F.trim(raw), F.lit("")).try_cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "part").groupBy(kind.alias("categoria")).agg(F.count("*").alias("filas"), money_sum(number).alias("total"))
