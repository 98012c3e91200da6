"""Reading the layer tables and the domain views that the plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of one scale directory; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Invoice lines in the commercial vocabulary.

    agency = customer's nation, brand and family from the part, a returned line
    (``l_returnflag = 'R'``) is a return and any other a sale; cost is 60 % of value.
    Nation, customer and part are joined without hints: their size decides. With ``wanted`` columns only
    the tables that hold them are joined: keys are taken to be found in the tables they point to.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    returned = F.col("l_returnflag") == "R"
    columns = {
        "agency": F.col("n_name"),
        "product_id": F.col("l_partkey"),
        "product_name": F.col("p_name"),
        "brand": F.col("p_brand"),
        "family": F.col("p_type"),
        "customer_id": F.col("o_custkey"),
        "segment": F.col("c_mktsegment"),
        "order_id": F.col("l_orderkey"),
        "line_no": F.col("l_linenumber"),
        "order_status": F.col("o_orderstatus"),
        "line_status": F.col("l_linestatus"),
        "order_date": F.to_date("o_orderdate"),
        "anio": F.year("o_orderdate"),
        "mes": F.month("o_orderdate"),
        "periodo": F.trunc(F.to_date("o_orderdate"), "MM"),
        "qty": F.col("l_quantity"),
        "value": F.col("l_extendedprice"),
        "total_venta": F.when(returned, 0.0).otherwise(F.col("l_extendedprice")),
        "total_devolucion": F.when(returned, F.col("l_extendedprice")).otherwise(0.0),
        "cant_venta": F.when(returned, 0.0).otherwise(F.col("l_quantity")),
        "cant_devolucion": F.when(returned, F.col("l_quantity")).otherwise(0.0),
        "costo_venta": F.col("l_extendedprice") * 0.6,
    }
    asked = set(wanted or columns)
    out = lines
    if asked & {"agency", "segment", "customer_id", "order_status", "order_date", "anio", "mes", "periodo"}:
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if asked & {"agency", "segment"}:
        out = out.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    if "agency" in asked:
        out = out.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    if asked & {"product_name", "brand", "family"}:
        out = out.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return out.select(*(c.alias(name) for name, c in columns.items() if name in asked))


#: The same rows as ``sales`` for the oracles.
SALES_SQL = """
SELECT n_name AS agency, p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS family,
       c_custkey AS customer_id, c_mktsegment AS segment, l_orderkey AS order_id, l_linenumber AS line_no,
       o_orderstatus AS order_status, l_linestatus AS line_status, CAST(o_orderdate AS DATE) AS order_date,
       CAST(year(o_orderdate) AS INTEGER) AS anio, CAST(month(o_orderdate) AS INTEGER) AS mes,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS periodo, l_quantity AS qty, l_extendedprice AS value,
       CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_extendedprice END AS total_venta,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0::DOUBLE END AS total_devolucion,
       CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity END AS cant_venta,
       CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0::DOUBLE END AS cant_devolucion,
       l_extendedprice * 0.6::DOUBLE AS costo_venta
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
"""


def money_sum(column: str | F.Column) -> F.Column:
    """A sum that doesn't depend on the order of the rows: exact decimals, then double."""
    col = F.col(column) if isinstance(column, str) else column
    return F.sum(col.cast("decimal(18,4)")).cast("double")


def monthly_panel(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """(product_id, periodo, target_qty) from the sales lines, by brand (dense) or by part (sparse)."""
    lines = sales(spark, sf_dir, by, "periodo", "cant_venta")
    return lines.groupBy(F.col(by).cast("string").alias("product_id"), "periodo").agg(money_sum("cant_venta").alias("target_qty"))


def panel_sql(by: str = "brand") -> str:
    return f"SELECT CAST({by} AS VARCHAR) AS product_id, periodo, CAST(SUM(CAST(cant_venta AS DECIMAL(18,4))) AS DOUBLE) AS target_qty FROM ({SALES_SQL}) GROUP BY ALL"
