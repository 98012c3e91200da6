"""Catalogue and monthly sales cleaned, the canonical product of every code, and the monthly base that forecasts start from.

Null and missing-like texts (nan, none) count as empty, numbers that aren't any as 0. An empty code is a code
like others. Ties go by the smallest text. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siembra.functions.dates import month_index, month_start
from siembra.functions.numeric import finite
from siembra.functions.text import clean_string, ean_digits, ean_valid, item_leaf, normalize_product_name, padded_code, zfill
from siembra.sources.scratch import written

# Descriptions that say nothing. Callers add their company's own.
GENERIC = ("", "PT", "PP", "PRODUCTO TERMINADO", "NONE", "NAN")
# Months without sales that make a product inactive; months of the year that make it seasonal at most.
INACTIVE_MONTHS, SEASONAL_MONTHS = 6, 4


def _number(c: str) -> Column:
    return F.coalesce(finite(F.col(c).try_cast("double")), F.lit(0.0))


def _exact_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def clean_catalogue(df: DataFrame, generic: Sequence[str] = GENERIC) -> DataFrame:
    """Items with leaf, code, kind (PT, PP or OTRO), digits of both EANs, and the name to show: the description unless it is generic."""
    text = {c: clean_string(F.col(c)) for c in ("item", "description", "ean13", "ean14", "um")}
    rows = df.withColumns({**text, "price": _number("price")}).where("item != ''")
    kind = F.upper(F.trim(F.substring_index("item", ":", 1)))
    rows = rows.withColumns({"item_tail": item_leaf(F.col("item")), "codigo_producto": F.coalesce(padded_code(F.col("item")), F.lit("")), "tipo_producto": F.when(kind.isin("PT", "PP"), kind).otherwise("OTRO")})
    rows = rows.withColumns({"ean13": ean_digits(F.col("ean13")), "ean14": ean_digits(F.col("ean14")), "flag_ean13_valido": ean_valid(F.col("ean13")), "flag_desc_generica": F.upper("description").isin(*generic)})
    rows = rows.withColumn("producto_dashboard", F.when(F.col("flag_desc_generica"), F.col("item_tail")).otherwise(F.col("description")))
    return rows.select("item", "item_tail", "description", "producto_dashboard", "tipo_producto", "codigo_producto", "ean13", "ean14", "um", "price", "flag_ean13_valido", "flag_desc_generica")


def clean_monthly_sales(df: DataFrame) -> DataFrame:
    """Sums by brand, family, product, code in parentheses and month; a month comes from year and month name. Rows without product or month go."""
    text = {c: clean_string(F.col(c)) for c in ("marca", "familia", "producto")}
    rows = df.withColumns({**text, "periodo": month_start(_number("anio").cast("int"), F.col("mes"))}).where("periodo IS NOT NULL AND producto != ''")
    rows = rows.withColumn("__code", F.regexp_extract("producto", r"\((\d+)\)", 1))  # by itself: its pattern is sought once a row
    rows = rows.withColumn("codigo_producto", F.when(F.col("__code") == "", "").otherwise(zfill(F.col("__code"))))
    sums = (_exact_sum(_number(c)).alias(c) for c in ("recuento_cliente", "cantidad", "ventas"))
    return rows.groupBy("marca", "familia", "producto", "codigo_producto", "periodo").agg(*sums)


def canonical_products(catalogue: DataFrame, sales: DataFrame) -> DataFrame:
    """The best item of every code (valid EAN 4, telling description 3, any description 2, a leaf 1), EANs of several names, and whether the code was sold."""
    score = F.col("flag_ean13_valido").cast("int") * 4 + (~F.col("flag_desc_generica")).cast("int") * 3 + (F.col("description") != "").cast("int") * 2 + (F.col("item_tail") != "").cast("int")
    parts = ("item", "description", "ean13", "ean14", "producto_dashboard", "tipo_producto")
    best = catalogue.groupBy("codigo_producto").agg(F.min(F.struct((-score).alias("o"), *parts)).alias("b")).select("codigo_producto", *(f"b.{c}" for c in parts))
    names = catalogue.where("flag_ean13_valido").groupBy("ean13").agg((F.countDistinct("producto_dashboard") > 1).alias("flag_conflicto_ean13"))
    sold = sales.select("codigo_producto").distinct().withColumn("__sold", F.lit(True))
    out = best.join(names, "ean13", "left").join(sold, "codigo_producto", "left")
    return out.select(
        "codigo_producto", "ean13", "ean14", F.col("item").alias("item_canonico"), F.col("description").alias("description_canonica"), "producto_dashboard", F.when(F.col("tipo_producto") == "PP", "PP").otherwise("PT").alias("tipo_producto"),
        F.when(F.col("__sold"), "exacto").otherwise("sin_match").alias("estado_match"), F.coalesce("flag_conflicto_ean13", F.lit(False)).alias("flag_conflicto_ean13"),
    )


def forecasting_base(sales: DataFrame, dim: DataFrame) -> DataFrame:
    """Monthly quantities of products with kind, category and state, one row a code, EAN and month.

    A product outside the catalogue that has the name of a finished one goes. A product is its EAN if that has 13 digits, else its
    code; it is inactive without sales in the last six months and seasonal if it was sold in four months of the year at most.
    ``dim`` has one row a code, so what it says is looked up once a code and joined to the sums; names are normalised once a spelling.
    """
    own = dim.select("codigo_producto", "ean13", "item_canonico", "producto_dashboard", "tipo_producto", "flag_conflicto_ean13").withColumn("__tipo", F.upper(F.trim(F.coalesce("tipo_producto", F.lit("OTRO")))))
    kind = F.coalesce("__tipo", F.lit("OTRO"))
    shown = sales.groupBy("codigo_producto", "producto").agg(F.lit(1).alias("n")).join(own, "codigo_producto", "left")
    names = shown.groupBy(F.coalesce("producto_dashboard", "producto").alias("__shown")).agg(F.max(kind == "PT").alias("__pt")).withColumn("__name", normalize_product_name(F.col("__shown")))
    finished = names.where("__pt").select("__name").distinct()
    twins = names.join(finished, "__name", "left_semi").select(F.col("__shown").alias("__twin"))
    gone = shown.where(kind == "OTRO").join(twins, F.coalesce("producto_dashboard", "producto").eqNullSafe(F.col("__twin"))).select(F.col("codigo_producto").alias("__code"), F.col("producto").alias("__product"))
    rows = sales.join(gone, F.col("codigo_producto").eqNullSafe(F.col("__code")) & F.col("producto").eqNullSafe(F.col("__product")), "left_anti")

    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).alias(c)
    keys = ("periodo", "marca", "familia", "codigo_producto")
    products = rows.repartition(*keys).groupBy(*keys, "producto").agg(F.count("*").alias("n"), F.max(F.col("cantidad") > 0).alias("__some"), *(exact(c) for c in ("cantidad", "ventas", "recuento_cliente")))
    often = F.min(F.when(F.col("producto").isNotNull(), F.struct((-F.col("n")).alias("n"), "producto"))).getField("producto")
    total = lambda c, name: F.sum(c).cast("double").alias(name)
    sums = written(products.groupBy(*keys).agg(often.alias("producto"), F.max("__some").alias("__some"), total("cantidad", "qty_vendida"), total("ventas", "ventas_valor"), total("recuento_cliente", "clientes")), "sums")

    months = sums.groupBy("codigo_producto", "periodo").agg(F.max("__some").alias("__some")).join(own.select("codigo_producto", "ean13"), "codigo_producto", "left")
    key = lambda: F.when(F.length("ean13") == 13, F.col("ean13")).otherwise(F.col("codigo_producto"))
    life = months.groupBy(key().alias("__key")).agg(F.max("periodo").alias("__last"), F.countDistinct(F.when(F.col("__some"), F.month("periodo"))).alias("__months"))
    newest = sums.agg(F.max("periodo").alias("m")).scalar()
    state = F.when(month_index(newest) - month_index(F.col("__last")) >= INACTIVE_MONTHS, "INACTIVO").when(F.col("__months") <= SEASONAL_MONTHS, "ESTACIONAL").otherwise("ACTIVO")
    out = sums.join(own, "codigo_producto", "left").withColumn("__key", key()).join(life, "__key")
    return out.select(
        "periodo", "marca", "familia", "codigo_producto", F.coalesce("ean13", F.lit("")).alias("ean13"), F.when(kind == "PT", "PT").otherwise("OTRO").alias("tipo_producto"), F.upper(F.trim("familia")).alias("categoria_producto"), state.alias("estado_producto"),
        F.coalesce("flag_conflicto_ean13", F.lit(False)).alias("flag_catalogo_conflicto"), F.coalesce("item_canonico", "producto").alias("producto_item"), F.coalesce("producto_dashboard", "producto").alias("producto_dashboard"), "qty_vendida", "ventas_valor", "clientes",
    )
