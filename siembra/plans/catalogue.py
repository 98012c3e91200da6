"""Catalogue, monthly sales, canonical products and the monthly base of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siembra.functions.dates import MONTH_NAMES
from siembra.operators import catalogue as C
from siembra.plans.registry import query
from siembra.sources.scratch import written
from siembra.sources.tables import table

_MONTHS = "['" + "', '".join(MONTH_NAMES[m] for m in range(1, 13)) + "']"

_CATALOGUE = """
WITH r AS (SELECT CASE WHEN p_partkey % 31 = 0 THEN ' nan' ELSE CASE p_partkey % 5 WHEN 0 THEN 'PP:' WHEN 1 THEN 'XX:' ELSE 'PT:' END || p_type || ': ' || p_name || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE ' (' || p_partkey % 700 || ')' END END AS item,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN 'Producto terminado' ELSE upper(p_name) END AS description, CASE WHEN p_partkey % 9 = 0 THEN '12-3' ELSE CAST(7860000000000 + p_partkey % 700 AS VARCHAR) END AS ean13 FROM part),
c AS (SELECT item, trim(string_split(item, ':')[-1]) AS item_tail, CASE WHEN lower(description) = 'none' THEN '' ELSE description END AS description, CASE WHEN item[1:2] IN ('PT', 'PP') THEN item[1:2] ELSE 'OTRO' END AS tipo_producto,
  CASE WHEN item LIKE '%(%' THEN lpad(regexp_extract(item, '\\((\\d+)\\)', 1), greatest(4, CAST(length(regexp_extract(item, '\\((\\d+)\\)', 1)) AS INTEGER)), '0') ELSE '' END AS codigo_producto, regexp_replace(ean13, '\\D', '', 'g') AS ean13 FROM r WHERE trim(item) <> 'nan'),
cat AS (SELECT *, length(ean13) = 13 AS flag_ean13_valido, upper(description) IN ('', 'PRODUCTO TERMINADO') AS flag_desc_generica, CASE WHEN upper(description) IN ('', 'PRODUCTO TERMINADO') THEN item_tail ELSE description END AS producto_dashboard FROM c)
"""

_SALES = f""",
v AS (SELECT p_brand AS marca, p_type AS familia, CASE WHEN l_partkey % 41 = 0 THEN '' ELSE p_name || CASE WHEN l_partkey % 17 = 0 THEN '' ELSE ' (' || l_partkey % 900 || ')' END END AS producto, year(l_shipdate) AS anio,
  CASE WHEN l_partkey % 43 = 0 THEN 'trece' ELSE {_MONTHS}[month(l_shipdate)] END AS mes, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS cantidad, l_extendedprice AS ventas, CAST(date_trunc('month', l_shipdate) AS DATE) AS periodo FROM lineitem JOIN part ON l_partkey = p_partkey),
ven AS (SELECT marca, familia, producto, CASE WHEN producto LIKE '%(%' THEN lpad(regexp_extract(producto, '\\((\\d+)\\)', 1), greatest(4, CAST(length(regexp_extract(producto, '\\((\\d+)\\)', 1)) AS INTEGER)), '0') ELSE '' END AS codigo_producto, periodo, CAST(COUNT(*) AS DOUBLE) AS recuento_cliente,
  CAST(SUM(CAST(cantidad AS DECIMAL(18,4))) AS DOUBLE) AS cantidad, CAST(SUM(CAST(ventas AS DECIMAL(18,4))) AS DOUBLE) AS ventas FROM v WHERE producto <> '' AND mes <> 'trece' GROUP BY marca, familia, producto, periodo)
"""

_DIM = """,
best AS (SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY codigo_producto ORDER BY CAST(flag_ean13_valido AS INT) * 4 + CAST(NOT flag_desc_generica AS INT) * 3 + CAST(description <> '' AS INT) * 2 + CAST(item_tail <> '' AS INT) DESC, item, description, ean13) = 1),
conf AS (SELECT ean13, COUNT(DISTINCT producto_dashboard) > 1 AS x FROM cat WHERE flag_ean13_valido GROUP BY ean13),
dim AS (SELECT codigo_producto, ean13, '' AS ean14, item AS item_canonico, description AS description_canonica, producto_dashboard, CASE WHEN tipo_producto = 'PP' THEN 'PP' ELSE 'PT' END AS tipo_producto,
  CASE WHEN codigo_producto IN (SELECT codigo_producto FROM ven) THEN 'exacto' ELSE 'sin_match' END AS estado_match, coalesce(x, false) AS flag_conflicto_ean13 FROM best LEFT JOIN conf USING (ean13))
"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue items: paths of kind, type and name with a code that several share, descriptions that often say nothing."""
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "PP:").when(k % 5 == 1, "XX:").otherwise("PT:")
    code = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" ("), (k % 700).cast("string"), F.lit(")")))
    item = F.when(k % 31 == 0, " nan").otherwise(F.concat(kind, "p_type", F.lit(": "), "p_name", code))
    description = F.when(k % 4 == 0, "").when(k % 4 == 1, "None").when(k % 4 == 2, "Producto terminado").otherwise(F.upper("p_name"))
    ean = F.when(k % 9 == 0, "12-3").otherwise((F.lit(7860000000000) + k % 700).cast("string"))
    return C.clean_catalogue(table(spark, sf_dir, "part").select(item.alias("item"), description.alias("description"), ean.alias("ean13"), F.lit(None).cast("string").alias("ean14"), F.lit("u").alias("um"), F.col("p_retailprice").alias("price")))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines as rows of a sales report: named months, one of them misspelt, products without a name or code."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    k = F.col("l_partkey")
    code = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit(" ("), (k % 900).cast("string"), F.lit(")")))
    names = F.array(*(F.lit(MONTH_NAMES[m]) for m in range(1, 13)))
    month = F.when(k % 43 == 0, "trece").otherwise(F.get(names, F.month("l_shipdate") - 1))
    rows = lines.join(part, k == F.col("p_partkey")).select(
        F.col("p_brand").alias("marca"), F.col("p_type").alias("familia"), F.when(k % 41 == 0, "").otherwise(F.concat("p_name", code)).alias("producto"), F.year("l_shipdate").alias("anio"), month.alias("mes"),
        F.lit(1).alias("recuento_cliente"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("cantidad"), F.col("l_extendedprice").alias("ventas"),
    )
    return C.clean_monthly_sales(rows)


@query("d07_catalogue", f"{_CATALOGUE} SELECT item, item_tail, description, producto_dashboard, tipo_producto, codigo_producto, ean13, flag_ean13_valido, flag_desc_generica FROM cat")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).drop("ean14", "um", "price")


@query("d08_monthly_sales", f"{_CATALOGUE}{_SALES} SELECT marca, familia, producto, codigo_producto, CAST(periodo AS VARCHAR) AS periodo, recuento_cliente, cantidad, ventas FROM ven")
def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).withColumn("periodo", F.col("periodo").cast("string"))


@query("d09_canonical_products", f"{_CATALOGUE}{_SALES}{_DIM} SELECT * FROM dim")
def canonical_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonical_products(_catalogue(spark, sf_dir), _monthly(spark, sf_dir))


@query(
    "d09_forecasting_base",
    f"""{_CATALOGUE}{_SALES}{_DIM},
j AS (SELECT ven.*, coalesce(item_canonico, producto) AS producto_item, coalesce(producto_dashboard, producto) AS nombre, coalesce(tipo_producto, 'OTRO') AS tipo, coalesce(ean13, '') AS ean13, coalesce(flag_conflicto_ean13, false) AS flag_catalogo_conflicto FROM ven LEFT JOIN dim USING (codigo_producto)),
n AS (SELECT *, trim(regexp_replace(upper(nombre), '[^A-Z0-9]+', ' ', 'g')) AS clave FROM j),
b AS (SELECT *, CASE WHEN length(ean13) = 13 THEN ean13 ELSE codigo_producto END AS k FROM n WHERE tipo <> 'OTRO' OR clave NOT IN (SELECT clave FROM n WHERE tipo = 'PT')),
l AS (SELECT k, MAX(periodo) AS ultimo, COUNT(DISTINCT CASE WHEN cantidad > 0 THEN month(periodo) END) AS meses FROM b GROUP BY k), m AS (SELECT MAX(periodo) AS m FROM b),
s AS (SELECT b.*, CASE WHEN (year(m) - year(ultimo)) * 12 + month(m) - month(ultimo) >= 6 THEN 'INACTIVO' WHEN meses <= 4 THEN 'ESTACIONAL' ELSE 'ACTIVO' END AS estado_producto FROM b JOIN l USING (k), m),
g AS (SELECT periodo, marca, familia, codigo_producto, ean13, CASE WHEN tipo = 'PT' THEN 'PT' ELSE 'OTRO' END AS tipo_producto, upper(trim(familia)) AS categoria_producto, estado_producto, flag_catalogo_conflicto, producto_item, nombre, cantidad, ventas, recuento_cliente FROM s),
u AS (SELECT periodo, marca, familia, codigo_producto, ean13, tipo_producto, categoria_producto, estado_producto, flag_catalogo_conflicto, CAST(SUM(CAST(cantidad AS DECIMAL(18,4))) AS DOUBLE) AS qty_vendida, CAST(SUM(CAST(ventas AS DECIMAL(18,4))) AS DOUBLE) AS ventas_valor, SUM(recuento_cliente) AS clientes FROM g GROUP BY ALL),
i AS (SELECT periodo, marca, familia, codigo_producto, ean13, tipo_producto, producto_item FROM g GROUP BY ALL QUALIFY_I), d AS (SELECT periodo, marca, familia, codigo_producto, ean13, tipo_producto, nombre AS producto_dashboard FROM g GROUP BY ALL QUALIFY_D)
SELECT u.* REPLACE (CAST(u.periodo AS VARCHAR) AS periodo), producto_item, producto_dashboard FROM u JOIN i USING (periodo, marca, familia, codigo_producto, ean13, tipo_producto) JOIN d USING (periodo, marca, familia, codigo_producto, ean13, tipo_producto)
""".replace("GROUP BY ALL QUALIFY_I", "GROUP BY periodo, marca, familia, codigo_producto, ean13, tipo_producto, producto_item QUALIFY row_number() OVER (PARTITION BY periodo, marca, familia, codigo_producto, ean13, tipo_producto ORDER BY COUNT(*) DESC, producto_item) = 1").replace(
        "GROUP BY ALL QUALIFY_D", "GROUP BY periodo, marca, familia, codigo_producto, ean13, tipo_producto, nombre QUALIFY row_number() OVER (PARTITION BY periodo, marca, familia, codigo_producto, ean13, tipo_producto ORDER BY COUNT(*) DESC, nombre) = 1"
    ),
)
def forecasting_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = written(_monthly(spark, sf_dir), "sales")
    return C.forecasting_base(sales, C.canonical_products(_catalogue(spark, sf_dir), sales)).withColumn("periodo", F.col("periodo").cast("string"))
