"""Relational queries: scans, joins, deduplication, reshaping, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.functions import dates as D
from siembra.functions import numeric as N
from siembra.functions import text as X
from siembra.operators import mining as M
from siembra.operators import one_class as OC
from siembra.operators import relational as R
from siembra.plans.registry import query
from siembra.sources.scratch import written
from siembra.sources.tables import SALES_SQL, money_sum, monthly_panel, panel_sql, sales, table


@query("s02_json_landing", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE nullif(trim(json_extract_string(props, '$.k')), '') IS NOT NULL")
def json_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a JSON landing column; rows without the required key go."""
    k = F.nullif(F.trim(F.from_json("props", "map<string,string>")["k"]), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null")


@query("s04_latest_record", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_best(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("s05_row_fingerprint", "SELECT p_partkey, md5(concat_ws('|', coalesce(p_name, ''), coalesce(p_brand, ''), coalesce(CAST(p_size AS VARCHAR), ''))) AS row_hash FROM part")
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.row_fingerprint("p_name", "p_brand", "p_size").alias("row_hash"))


@query(
    "s06_month_names",
    """
WITH m(n, nombre) AS (VALUES (1,'enero'),(2,'Febrero'),(3,'marzo '),(4,'ABRIL'),(5,'mayo'),(6,'junio'),(7,'julio'),(8,'agosto'),(9,'setiembre'),(10,'octubre'),(11,'noviembre'),(12,'diciembre'))
SELECT o_orderkey, CAST(make_date(year(o_orderdate), n, 1) AS VARCHAR) AS periodo FROM orders JOIN m ON month(o_orderdate) = n
""",
)
def month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month names in any case and spelling back to the first of the month."""
    spelled = {1: "enero", 2: "Febrero", 3: "marzo ", 4: "ABRIL", 5: "mayo", 6: "junio", 7: "julio", 8: "agosto", 9: "setiembre", 10: "octubre", 11: "noviembre", 12: "diciembre"}
    name = N.lookup(F.month("o_orderdate").cast("string"), {str(k): v for k, v in spelled.items()})
    return table(spark, sf_dir, "orders").select("o_orderkey", D.month_start(F.year("o_orderdate").cast("string"), name).cast("string").alias("periodo"))


@query("s20_parent_child", "SELECT o_orderkey, coalesce(n, 0) AS lineas, coalesce(q, 0.0) AS cantidad, coalesce(d, 0) AS productos FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(l_quantity) AS q, COUNT(DISTINCT l_partkey) AS d FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.countDistinct("l_partkey").alias("d"))
    return table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lineas"), F.coalesce("q", F.lit(0.0)).alias("cantidad"), F.coalesce("d", F.lit(0)).alias("productos"))


@query(
    "p10_conform",
    "SELECT o_orderkey, CAST(greatest(least(round_even(o_totalprice, 2), 99999.99), -99999.99) AS DOUBLE) AS importe, CAST(CAST(o_custkey AS INTEGER) AS INTEGER) AS cliente, CAST(NULL AS VARCHAR) AS nota FROM orders",
)
def conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conform to numeric(7,2), int and a missing column; the decimal is shown as a double."""
    shape = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("importe", T.DecimalType(7, 2)), T.StructField("cliente", T.IntegerType()), T.StructField("nota", T.StringType())])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("importe"), F.col("o_custkey").alias("cliente"))
    return R.conform(o, shape).withColumn("importe", F.col("importe").cast("double"))


@query(
    "j01_full_outer",
    """
WITH v AS (SELECT l_partkey AS k, CAST(SUM(l_quantity) AS DOUBLE) AS cantidad, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS valor FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 GROUP BY l_partkey),
m AS (SELECT l_partkey AS k, CAST(SUM(l_quantity) AS DOUBLE) AS cantidad, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS valor FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY l_partkey)
SELECT coalesce(v.k, m.k) AS k, CASE WHEN coalesce(v.cantidad, 0) > 0 THEN v.cantidad ELSE coalesce(m.cantidad, 0) END AS cantidad, CASE WHEN coalesce(v.valor, 0) > 0 THEN v.valor ELSE coalesce(m.valor, 0) END AS valor
FROM v FULL OUTER JOIN m ON v.k = m.k
""",
)
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two summaries by key, null as 0, the left value if positive."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    side = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("cantidad"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("valor"))
    return R.full_outer_merge(side("A"), side("R"), ["k"], ["cantidad", "valor"])


@query(
    "j04_stock_match",
    """
WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part),
pk AS (SELECT p_partkey, 'code:' || (p_partkey % 97) AS match_key, 1 AS pp FROM p UNION SELECT p_partkey, upper(p_brand), 2 FROM p UNION SELECT p_partkey, upper(p_type), 3 FROM p),
s AS (SELECT s_suppkey, s_suppkey % 89 AS c FROM supplier),
sk AS (SELECT s_suppkey, 'code:' || c AS match_key, 1 AS sp FROM s UNION SELECT s_suppkey, 'BRAND#' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0'), 2 FROM s),
j AS (SELECT p_partkey, s_suppkey, pp + sp AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY pp + sp, pp, sp, s_suppkey) AS r FROM pk JOIN sk USING (match_key))
SELECT p_partkey, s_suppkey, score FROM j WHERE r = 1
""",
)
def stock_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and stock items by several keys with priorities; the best sum wins."""
    keys = lambda *pairs: F.explode(F.array(*(F.struct(k.alias("match_key"), F.lit(p).alias("prio")) for k, p in pairs)))
    p = table(spark, sf_dir, "part")
    pk = p.select("p_partkey", keys((F.concat(F.lit("code:"), (F.col("p_partkey") % 97).cast("string")), 1), (F.upper("p_brand"), 2), (F.upper("p_type"), 3)).alias("m")).select("p_partkey", "m.match_key", F.col("m.prio").alias("pp")).distinct()
    s = table(spark, sf_dir, "supplier")
    sk = s.select("s_suppkey", keys((F.concat(F.lit("code:"), (F.col("s_suppkey") % 89).cast("string")), 1), (F.concat(F.lit("BRAND#"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0")), 2)).alias("m")).select("s_suppkey", "m.match_key", F.col("m.prio").alias("sp")).distinct()
    best = R.candidate_best(pk, sk, "match_key", "p_partkey", F.col("pp") + F.col("sp"), "pp", "sp", "s_suppkey", among=("sp", "s_suppkey"))
    return best.select("p_partkey", "s_suppkey", (F.col("pp") + F.col("sp")).alias("score"))


@query("j05_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("j06_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) >= 1999)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 1999), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("j10_latest_period", f"WITH p AS ({panel_sql()}) SELECT product_id, target_qty FROM p WHERE periodo = (SELECT MAX(periodo) FROM p)")
def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly_panel(spark, sf_dir)
    return p.where(F.col("periodo") == p.agg(F.max("periodo").alias("m")).scalar()).select("product_id", "target_qty")


@query("j16_containment", "WITH f AS (SELECT DISTINCT substr(n_name, 1, 4) AS fam FROM nation) SELECT DISTINCT n_name FROM nation WHERE EXISTS (SELECT 1 FROM f WHERE contains(upper(n_name), upper(fam)) AND length(fam) >= 4)")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a family's prefix: both are cut into equal pieces first, so it is an equi-join."""
    n = table(spark, sf_dir, "nation").select("n_name").distinct()
    fam = n.select(F.upper(F.substring("n_name", 1, 4)).alias("fam")).where(F.length("fam") >= 4).distinct()
    pieces = n.where(F.length("n_name") >= 4).withColumn("fam", F.explode(F.transform(F.sequence(F.lit(1), F.length("n_name") - 3), lambda i: F.upper(F.substring(F.col("n_name"), i, F.lit(4))))))
    return pieces.join(fam, "fam", "left_semi").select("n_name").distinct()


@query(
    "j17_point_in_period",
    """
WITH v AS (SELECT p_partkey, CAST(DATE '1995-01-01' + INTERVAL (p_partkey % 36) MONTH AS DATE) AS corte FROM part)
SELECT l_orderkey, l_linenumber, l_partkey || CASE WHEN CAST(l_shipdate AS DATE) < corte THEN '_V1' ELSE '_V2' END AS sku_id FROM lineitem JOIN v ON l_partkey = p_partkey
""",
)
def point_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to the version of their product that was valid: an equi-join on the code with a date range."""
    cut = F.add_months(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 36).cast("int"))
    v = table(spark, sf_dir, "part").select("p_partkey", cut.alias("corte"))
    far, early = F.lit("9999-12-31").cast("date"), F.lit("0001-01-01").cast("date")
    versions = v.select("p_partkey", F.explode(F.array(F.struct(F.lit(1).alias("n"), early.alias("desde"), F.col("corte").alias("hasta")), F.struct(F.lit(2).alias("n"), F.col("corte").alias("desde"), far.alias("hasta")))).alias("v")).select("p_partkey", "v.*")
    lines = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    j = lines.join(versions, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("d") >= F.col("desde")) & (F.col("d") < F.col("hasta")))
    return j.select("l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), F.lit("_V"), F.col("n").cast("string")).alias("sku_id"))


@query("r03_duplicate_keys", "SELECT l_orderkey, l_partkey, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "r06_template",
    f"WITH p AS ({panel_sql()}), k AS (SELECT DISTINCT product_id FROM p), m AS (SELECT CAST(unnest(generate_series(MAX(periodo) + INTERVAL 1 MONTH, MAX(periodo) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE) AS periodo FROM p) SELECT product_id, CAST(periodo AS VARCHAR) AS periodo, 0.0::DOUBLE AS cantidad FROM k, m",
)
def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the six months after the last one: an explode, not a join."""
    p = monthly_panel(spark, sf_dir)
    last = p.agg(F.max("periodo").alias("m")).scalar()
    months = F.explode(F.sequence(F.add_months(last, 1), F.add_months(last, 6), F.expr("interval 1 month")))
    return p.select("product_id").distinct().select("product_id", months.alias("m")).select("product_id", F.col("m").cast("string").alias("periodo"), F.lit(0.0).alias("cantidad"))


@query("r07_pivot", "SELECT l_returnflag, coalesce(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0.0) AS F, coalesce(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0.0) AS O FROM lineitem GROUP BY l_returnflag")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity")).na.fill(0.0)


@query("r08_unpivot", "SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), "p_brand")
    return p.unpivot(["p_partkey"], ["p_size", "p_brand"], "metric", "value")


@query("r11_ordinal", "WITH t AS (SELECT DISTINCT p_type FROM part WHERE p_size <= 25), o AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM t) SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN o USING (p_type)")
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of categories seen in training rows, -1 for others; the categories are an array of distinct names."""
    p = table(spark, sf_dir, "part")
    seen = p.where("p_size <= 25").agg(F.array_sort(F.collect_set("p_type")).alias("c")).scalar()
    return p.select("p_partkey", (F.coalesce(F.array_position(seen, F.col("p_type")), F.lit(0)) - 1).cast("int").alias("code"))


@query(
    "c04_product_names",
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name || ' & (' || p_partkey || ') $1.50'), '&', ' Y ', 'g'), '[^A-Z0-9]+', ' ', 'g')) AS nombre, CASE WHEN p_partkey BETWEEN 100 AND 999999 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS codigo, md5(p_name)[1:10] AS hash FROM part",
)
def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" & ("), F.col("p_partkey").cast("string"), F.lit(") $1.50"))
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_product_name(raw).alias("nombre"), X.extract_product_code(raw).alias("codigo"), X.stable_hash(F.col("p_name")).alias("hash"))


@query("c12_product_ids", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'PT_' || p_partkey ELSE 'PT_' || sha1(p_name)[1:10] END AS product_id, CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END AS codigo FROM part")
def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", X.make_product_id("PT", code, F.col("p_name")).alias("product_id"), X.zfill(F.col("p_partkey").cast("string")).alias("codigo"))


@query("c21_ledger_numbers", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2))::DOUBLE AS valor FROM lineitem")
def ledger_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written as (1.234,56) and $ 1,234.56 read back."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.format_number("l_extendedprice", 2).alias("us"))
    us, eu = F.col("us"), F.translate("us", ",.", ".,")
    raw = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), eu, F.lit(")"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("$ "), us)).otherwise(eu)
    return lines.select("l_orderkey", "l_linenumber", raw.alias("raw")).select("l_orderkey", "l_linenumber", N.parse_ledger_number(F.col("raw")).alias("valor"))


@query("c25_calendar", "SELECT o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS trimestre, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dia, CAST(weekofyear(o_orderdate) AS INTEGER) AS semana, CAST(day(o_orderdate) = 1 AS INTEGER) AS inicio, CAST(last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS INTEGER) AS fin, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS indice FROM orders")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    flags = D.day_flags(d)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.quarter(d).alias("trimestre"), flags["weekday"].alias("dia"), flags["week"].alias("semana"), flags["is_month_start"].alias("inicio"), flags["is_month_end"].alias("fin"), D.month_index(d).alias("indice"))


@query("f09_bins", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 'a' WHEN l_quantity <= 10 THEN 'b' WHEN l_quantity <= 20 THEN 'c' ELSE 'd' END AS tramo FROM lineitem")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.right_closed(F.col("l_quantity"), [5, 10, 20], ["a", "b", "c", "d"]).alias("tramo"))


_BASKET = f"""
b0 AS (SELECT DISTINCT order_id, brand FROM ({SALES_SQL})), top AS (SELECT brand FROM b0 GROUP BY brand ORDER BY COUNT(*) DESC, brand LIMIT 120),
b1 AS (SELECT * FROM b0 WHERE brand IN (SELECT brand FROM top)), b AS (SELECT * FROM b1 WHERE order_id IN (SELECT order_id FROM b1 GROUP BY order_id HAVING COUNT(*) >= 2)),
n AS (SELECT COUNT(DISTINCT order_id) AS n FROM b), s AS (SELECT brand, COUNT(*) AS c FROM b GROUP BY brand),
p AS (SELECT x.brand AS a, y.brand AS b, COUNT(*) AS n_ab FROM b x JOIN b y ON x.order_id = y.order_id AND x.brand < y.brand GROUP BY ALL)"""


@query("m01_pair_support", f"WITH {_BASKET} SELECT a, p.b AS b, n_ab, sa.c AS n_a, sb.c AS n_b, n.n AS n_baskets FROM p JOIN s sa ON sa.brand = a JOIN s sb ON sb.brand = p.b, n")
def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.baskets(sales(spark, sf_dir, "order_id", "brand"), "order_id", "brand", top_items=120)
    return M.pair_counts(pairs, "order_id", "brand")


@query(
    "m02_association_rules",
    f"""
WITH {_BASKET}, c AS (SELECT a, p.b AS b, n_ab, sa.c AS n_a, sb.c AS n_b, n.n AS n FROM p JOIN s sa ON sa.brand = a JOIN s sb ON sb.brand = p.b, n WHERE n_ab / n.n >= 0.005),
r AS (SELECT a, b, a AS antecedent, b AS consequent, n_ab / n AS support, n_ab / n_a AS confidence, n_ab * n / (n_a * n_b) AS lift FROM c UNION ALL SELECT a, b, b, a, n_ab / n, n_ab / n_b, n_ab * n / (n_a * n_b) FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY confidence DESC, antecedent) AS rn FROM r WHERE confidence >= 0.05)
SELECT antecedent, consequent, CAST(support AS DOUBLE) AS support, CAST(confidence AS DOUBLE) AS confidence, CAST(lift AS DOUBLE) AS lift, CASE WHEN lift > 2 THEN 'FUERTE' WHEN lift > 1.5 THEN 'MODERADA' ELSE 'DEBIL' END AS fuerza FROM k WHERE rn = 1
""",
)
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.association_rules(pair_support(spark, sf_dir), 0.005, 0.05)


@query(
    "m06_agency_outliers",
    f"""
WITH a AS (SELECT agency, CAST(SUM(CAST(total_venta AS DECIMAL(18,4))) AS DOUBLE) AS ventas, CAST(SUM(CAST(total_devolucion AS DECIMAL(18,4))) AS DOUBLE) AS devolucion FROM ({SALES_SQL}) GROUP BY agency),
z AS (SELECT agency, (ventas - avg(ventas) OVER ()) / stddev_samp(ventas) OVER () AS zv, (devolucion - avg(devolucion) OVER ()) / stddev_samp(devolucion) OVER () AS zd FROM a),
g AS (SELECT agency, zv, zd, CASE WHEN zv >= 1.5 THEN 2 WHEN zv >= 1 THEN 1 WHEN zv <= -1.5 THEN -2 WHEN zv <= -1 THEN -1 ELSE 0 END AS pv, -CASE WHEN zd >= 1.5 THEN 2 WHEN zd >= 1 THEN 1 WHEN zd <= -1.5 THEN -2 WHEN zd <= -1 THEN -1 ELSE 0 END AS pd FROM z)
SELECT agency, round(zv, 6) AS z_ventas, round(zd, 6) AS z_devolucion, CAST(greatest(pv, 0) + greatest(pd, 0) AS INTEGER) AS puntos_positivos, CAST(greatest(-pv, 0) + greatest(-pd, 0) AS INTEGER) AS puntos_negativos,
 CASE WHEN greatest(pv, pd) > 0 AND least(pv, pd) < 0 THEN 'MIXTA' WHEN greatest(pv, pd) > 0 THEN 'POSITIVA' WHEN least(pv, pd) < 0 THEN 'NEGATIVA' ELSE 'NORMAL' END AS sentido,
 concat_ws(', ', CASE WHEN abs(zv) >= 1 THEN 'ventas' END, CASE WHEN abs(zd) >= 1 THEN 'devolucion' END) AS causas FROM g
""",
)
def agency_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z values of agencies with points, sense and causes of the deviation."""
    a = sales(spark, sf_dir).groupBy("agency").agg(money_sum("total_venta").alias("ventas"), money_sum("total_devolucion").alias("devolucion"))
    z = M.z_scores(a, ["ventas", "devolucion"])
    out = z.withColumns(M.explain_outlier(["ventas"], ["devolucion"]))
    return out.select("agency", F.round("z_ventas", 6).alias("z_ventas"), F.round("z_devolucion", 6).alias("z_devolucion"), "puntos_positivos", "puntos_negativos", "sentido", "causas")


def _agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sales(spark, sf_dir, "agency", "total_venta", "total_devolucion", "costo_venta").groupBy("agency").agg(money_sum("total_venta").alias("ventas"), money_sum("total_devolucion").alias("devolucion"), money_sum("costo_venta").alias("costo"), F.count("*").alias("lineas"))
    return written(a, "agencies").withColumns({"ratio_devolucion": N.safe_ratio(F.col("devolucion"), F.col("ventas")), "ratio_costo": N.safe_ratio(F.col("costo"), F.col("ventas"))})


@query("m05_isolation_forest")
def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.isolation_forest(_agencies(spark, sf_dir), ["ventas", "ratio_devolucion", "ratio_costo"])


@query("m08_lof_pca")
def lof_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _agencies(spark, sf_dir)
    columns = ["ventas", "ratio_devolucion", "ratio_costo"]
    return M.local_outlier_factor(a, "agency", columns).join(M.pca_reconstruction(a, columns).select("agency", "pca_error"), "agency")


_CUSTOMER = f"SELECT customer_id AS id, SUM(CAST(total_venta AS DECIMAL(18,4))) AS a, SUM(CAST(total_devolucion AS DECIMAL(18,4))) AS b, COUNT(*) AS c FROM ({SALES_SQL}) GROUP BY customer_id"


@query(
    "m08_customer_lof",
    f"""
WITH r AS (SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM ({_CUSTOMER})), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM r),
z AS (SELECT id, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM r, m),
d AS (SELECT x.id, y.id AS other, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) AS d FROM z x JOIN z y ON x.id <> y.id),
k AS (SELECT id, other, d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 5), f AS (SELECT id, max(d) AS radius FROM k GROUP BY id),
p AS (SELECT k.id, 1 / greatest(avg(greatest(d, radius)), 1e-12) AS density FROM k JOIN f ON f.id = k.other GROUP BY k.id)
SELECT k.id AS customer_id, round(avg(o.density) / max(p.density), 5) AS lof FROM k JOIN p ON p.id = k.id JOIN p o ON o.id = k.other GROUP BY k.id
""",
)
def customer_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local outlier factors of customers by sales, returns and lines."""
    c = sales(spark, sf_dir, "customer_id", "total_venta", "total_devolucion").groupBy("customer_id").agg(money_sum("total_venta").alias("a"), money_sum("total_devolucion").alias("b"), F.count("*").cast("double").alias("c"))
    return M.local_outlier_factor(written(c, "customers"), "customer_id", ["a", "b", "c"]).withColumn("lof", F.round("lof", 5))


@query("m08_one_class")
def one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers outside the boundary around nine tenths of them, by sales, returns, ticket and lines."""
    c = sales(spark, sf_dir, "customer_id", "order_id", "total_venta", "total_devolucion").groupBy("customer_id").agg(money_sum("total_venta").alias("ventas"), money_sum("total_devolucion").alias("devolucion"), F.countDistinct("order_id").alias("ordenes"), F.count("*").cast("double").alias("lineas"))
    c = written(c.withColumns({"ratio_devolucion": N.safe_ratio(F.col("devolucion"), F.col("ventas")), "ticket": F.col("ventas") / F.col("ordenes")}), "customers")
    columns = ["ventas", "ratio_devolucion", "ticket", "lineas"]
    return OC.scored(c, OC.fit(c, columns), columns).select("customer_id", F.round("score", 6).alias("score"), "es_anomalia")


@query("m10_clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by sales and return rate in the number of clusters with the best silhouette."""
    p = written(sales(spark, sf_dir, "product_id", "total_venta", "total_devolucion").groupBy("product_id").agg(money_sum("total_venta").alias("ventas"), money_sum("total_devolucion").alias("d")), "products")
    p = p.withColumn("tasa", N.safe_ratio(F.col("d"), F.col("ventas")))
    return M.cluster(p, ["ventas", "tasa"], range(2, 6))[0].select("product_id", "cluster")


@query("m03_fp_growth")
def fp_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    pairs = M.baskets(sales(spark, sf_dir, "order_id", "brand"), "order_id", "brand", top_items=120)
    model = FPGrowth(itemsCol="items", minSupport=0.005, minConfidence=0.05).fit(pairs.groupBy("order_id").agg(F.collect_set("brand").alias("items")))
    return model.associationRules.where("size(antecedent) = 1").select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), "support", "confidence", "lift")
