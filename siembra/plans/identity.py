"""Product identity: the master kept up by batches of months in any order, conflicts, spellings and the gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siembra.operators import product_master as M
from siembra.plans.registry import query
from siembra.sources.scratch import dropped, shared_folder, written
from siembra.sources.tables import table

_BASE = """
SELECT CASE WHEN l_partkey % 23 = 0 THEN '' ELSE lpad(CAST(l_partkey % 400 AS VARCHAR), 4, '0') END AS codigo, CASE WHEN l_partkey % 46 = 0 THEN '' ELSE p_name || ' & Co.' END AS original,
  CASE WHEN l_partkey % 46 = 0 THEN '' ELSE upper(p_name) || ' Y CO' END AS nombre, CASE WHEN p_type LIKE 'ECO%' THEN NULL WHEN p_type LIKE 'S%' THEN 'PT' ELSE 'PP' END AS tipo, p_brand AS categoria,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS periodo, CAST(l_quantity AS DECIMAL(18,4)) AS qty, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines as products: 400 codes that several parts share, some lines without code, some without code and name."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    code = F.when(F.col("l_partkey") % 23 == 0, "").otherwise(F.lpad((F.col("l_partkey") % 400).cast("string"), 4, "0"))
    kind = F.when(F.col("p_type").like("ECO%"), None).when(F.col("p_type").like("S%"), "PT").otherwise("PP")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        code.alias("codigo_producto"), F.when(F.col("l_partkey") % 46 == 0, "").otherwise(F.concat("p_name", F.lit(" & Co."))).alias("producto_dashboard"), kind.alias("tipo_producto"),
        F.col("p_brand").alias("categoria_producto"), F.to_date("l_shipdate").alias("periodo"), F.col("l_quantity").alias("qty_vendida"), "l_linenumber",
    )


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condensed base, lines of every third number (``suelta``) apart. It is written: the optimiser takes a mere grouping below another out again."""
    single = F.coalesce(F.col("l_linenumber") % 3 == 0, F.lit(False))
    return written(M.condensed(_base(spark, sf_dir).withColumn("suelta", single), "suelta"), "shipped")


@query(
    "d11_sku_master",
    f"""
WITH b AS ({_BASE}), s AS (SELECT codigo, periodo, nombre, SUM(qty) AS q FROM b WHERE codigo <> '' GROUP BY ALL),
d AS (SELECT codigo, periodo, nombre FROM s QUALIFY row_number() OVER (PARTITION BY codigo, periodo ORDER BY q DESC, nombre) = 1),
f AS (SELECT *, CASE WHEN nombre IS DISTINCT FROM lag(nombre) OVER (PARTITION BY codigo ORDER BY periodo) THEN 1 ELSE 0 END AS nuevo FROM d),
v AS (SELECT *, SUM(nuevo) OVER (PARTITION BY codigo ORDER BY periodo) AS k FROM f),
r AS (SELECT codigo, k, any_value(nombre) AS nombre, MIN(periodo) AS desde, MAX(periodo) AS hasta FROM v GROUP BY codigo, k),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY codigo) AS m FROM r),
t AS (SELECT codigo, nombre, tipo FROM b WHERE tipo IS NOT NULL GROUP BY codigo, nombre, tipo QUALIFY row_number() OVER (PARTITION BY codigo, nombre ORDER BY COUNT(*) DESC, tipo) = 1),
c AS (SELECT codigo, nombre, categoria FROM b GROUP BY codigo, nombre, categoria QUALIFY row_number() OVER (PARTITION BY codigo, nombre ORDER BY COUNT(*) DESC, categoria) = 1),
u AS (SELECT CASE WHEN m = 1 THEN 'SKU_' || codigo ELSE 'SKU_' || codigo || '_V' || CAST(k AS BIGINT) END AS sku_id, codigo, nombre, desde, hasta, k = m AS activo, CASE WHEN m > 1 THEN 'MEDIA' ELSE 'ALTA' END AS calidad_sku, m > 1 AS flag_codigo_reciclado FROM n
 UNION ALL SELECT 'NO_CODE_' || md5(nombre)[1:10], '', nombre, MIN(periodo), MAX(periodo), true, 'BAJA', false FROM b WHERE codigo = '' AND nombre <> '' GROUP BY nombre)
SELECT sku_id, codigo AS codigo_producto, nombre AS producto_canonico, coalesce(tipo, 'OTRO') AS tipo_producto, coalesce(categoria, 'SIN_CATEGORIA') AS categoria_producto, CAST(desde AS VARCHAR) AS vigente_desde, CAST(hasta AS VARCHAR) AS vigente_hasta,
 activo, calidad_sku, flag_codigo_reciclado FROM u LEFT JOIN t USING (codigo, nombre) LEFT JOIN c USING (codigo, nombre)
""",
)
def sku_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master after four batches: even years, then odd ones (late months split runs), and two more of single lines within months already seen."""
    base = _shipped(spark, sf_dir)
    master = M.ProductMaster(spark, f"{shared_folder(spark)}/product-master-{uuid.uuid4().hex}")
    late, single = F.year("periodo") % 2 == 1, F.col("suelta")
    for batch, rows in {"even": ~late & ~single, "odd": late & ~single, "single-odd": late & single, "single-even": ~late & single}.items():
        master.absorb(base.where(rows), batch)
    dropped(base)
    return master.published().withColumns({c: F.col(c).cast("string") for c in ("vigente_desde", "vigente_hasta")})


@query(
    "d11_code_conflicts",
    f"""
WITH b AS ({_BASE}), n AS (SELECT codigo, nombre, MIN(periodo) AS a, MAX(periodo) AS z, row_number() OVER (PARTITION BY codigo ORDER BY nombre) AS r FROM b WHERE codigo <> '' GROUP BY codigo, nombre)
SELECT codigo AS codigo_producto, COUNT(*) AS nombres_distintos, CAST(MIN(a) AS VARCHAR) AS periodo_min, CAST(MAX(z) AS VARCHAR) AS periodo_max, string_agg(nombre, ' | ' ORDER BY r) FILTER (r <= 8) AS nombres_detectados,
 CASE WHEN COUNT(*) <= 2 THEN 'REVISAR_MERGE' ELSE 'REVISAR_SPLIT' END AS recomendacion, 'PENDIENTE_MANUAL' AS estado_resolucion FROM n GROUP BY codigo HAVING COUNT(*) > 1
""",
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.code_conflicts(M.sums(M.tidy(_shipped(spark, sf_dir)))).withColumns({c: F.col(c).cast("string") for c in ("periodo_min", "periodo_max")})


@query(
    "d11_name_mapping",
    f"""
WITH b AS ({_BASE}), s AS (SELECT codigo, nombre, SUM(qty) AS q FROM b WHERE codigo <> '' GROUP BY ALL),
c AS (SELECT codigo, nombre AS canonico, COUNT(*) OVER (PARTITION BY codigo) > 1 AS conflicto FROM s QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY q DESC, nombre) = 1),
e AS (SELECT DISTINCT codigo, original, nombre, tipo, categoria FROM b)
SELECT codigo AS codigo_producto, original AS nombre_original, nombre AS nombre_normalizado, coalesce(canonico, nombre) AS nombre_canonico, tipo AS tipo_producto, categoria AS categoria_producto,
 CASE WHEN coalesce(conflicto, false) THEN 'MANUAL_REVIEW' ELSE 'AUTO_MERGE' END AS decision_sugerida, coalesce(conflicto, false) AS requiere_revision_manual, coalesce(conflicto, false) AS flag_codigo_conflicto FROM e LEFT JOIN c USING (codigo)
""",
)
def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.name_mapping(M.tidy(_shipped(spark, sf_dir)))


@query(
    "d11_quality_gate",
    f"""
WITH b AS ({_BASE}), c AS (SELECT avg(CAST(n > 1 AS DOUBLE)) AS x FROM (SELECT COUNT(DISTINCT nombre) AS n FROM b WHERE codigo <> '' GROUP BY codigo)),
r AS (SELECT COUNT(*) FILTER (codigo = '') / CAST(COUNT(*) AS DOUBLE) AS y, COUNT(*) FILTER (codigo = '' AND nombre = '') / CAST(COUNT(*) AS DOUBLE) AS z FROM b)
SELECT x AS pct_codigos_con_conflicto, y AS pct_filas_sin_codigo, z AS pct_nombres_no_mapeados, 1 - z AS pct_match_exacto_maestro,
 CASE WHEN x > 0.05 OR y > 0.10 OR z > 0.05 THEN 'FAIL' WHEN x > 0.02 OR y > 0.05 OR z > 0.02 THEN 'WARNING' ELSE 'PASS' END AS status_calidad FROM c, r
""",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality_gate(M.sums(M.tidy(_shipped(spark, sf_dir))))
