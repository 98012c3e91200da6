"""Stock projections over forecast months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siembra.functions.numeric import finite
from siembra.operators.relational import keep_best

# Columns that people fill in the two templates, and what a product without stock is given.
POLICY_BLANKS = ("stock_minimo", "stock_maximo", "lead_time_dias", "lote_minimo_produccion", "observacion")
EXPERT_BLANKS = ("criterio_experto", "cantidad_ajustada_experto", "motivo_ajuste", "responsable_revision")
NO_STOCK = {"stock_actual": 0.0, "stock_encontrado": False, "stock_match_status": "sin_match_stock", "stock_item": "", "stock_item_description": "", "stock_avg_cost": 0.0, "stock_asset_value": 0.0}


def project_stock(df: DataFrame, demand: str = "cantidad_predicha", key: str = "product_id", month: str = "periodo") -> DataFrame:
    """Start, production, end and alert of every month of a product.

    Each month needs max(demand + minimum - start, 0), at most up to the maximum stock; the end
    is the next start. A product's horizon is a few months, so the recursion is a fold over its
    sorted rows. Expects stock_actual, stock_minimo, stock_maximo (nullable) and stock_encontrado.
    """
    row = F.struct(F.col(month).alias("month"), F.coalesce(F.col(demand).cast("double"), F.lit(0.0)).alias("demand"))
    g = df.groupBy(key).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.coalesce(F.max("stock_actual").cast("double"), F.lit(0.0)).alias("stock_actual"),
        F.coalesce(F.max("stock_minimo").cast("double"), F.lit(0.0)).alias("stock_minimo"), F.max("stock_maximo").cast("double").alias("stock_maximo"), F.coalesce(F.max("stock_encontrado"), F.lit(False)).alias("stock_encontrado"),
    )
    item = "struct<month:date,start:double,production:double,end:double>"
    begin = F.struct(F.col("stock_actual").alias("stock"), F.array().cast(f"array<{item}>").alias("out"))

    def step(state, x):
        need = F.greatest(x["demand"] + F.col("stock_minimo") - state["stock"], F.lit(0.0))
        made = F.when(F.col("stock_maximo").isNotNull(), F.least(need, F.greatest(F.col("stock_maximo") - state["stock"], F.lit(0.0)))).otherwise(need)
        end = state["stock"] + made - x["demand"]
        entry = F.struct(x["month"].cast("date").alias("month"), state["stock"].alias("start"), made.alias("production"), end.alias("end"))
        return F.struct(end.alias("stock"), F.concat(state["out"], F.array(entry)).alias("out"))

    folded = g.withColumn("e", F.explode(F.aggregate("rows", begin, step)["out"]))
    alert = F.when(~F.col("stock_encontrado"), "sin_stock_actual").when(F.col("stock_maximo").isNotNull() & (F.col("e.start") > F.col("stock_maximo")), "sobrestock").when(F.col("e.end") < F.col("stock_minimo"), "riesgo_quiebre_stock").otherwise("dentro_rango")
    return folded.select(key, F.col("e.month").alias(month), F.bround("e.start", 2).alias("stock_proyectado_inicio"), F.bround("e.end", 2).alias("stock_proyectado_fin"), F.bround("e.production", 2).alias("cantidad_a_producir_ajustada"), alert.alias("alerta_inventario"))


def scenarios(df: DataFrame, demands: Sequence[str] = ("prediccion_min", "cantidad_predicha", "prediccion_max"), key: str = "product_id", month: str = "periodo") -> DataFrame:
    """Production of the low, expected and high demand, never falling from one to the next."""
    out = df.select(key, month)
    for d in demands:
        p = project_stock(df, d, key, month).select(key, month, F.col("cantidad_a_producir_ajustada").alias(f"produccion_{d}"))
        out = out.join(p, [key, month])
    so_far = None
    for d in demands:
        c = F.col(f"produccion_{d}")
        so_far = c if so_far is None else F.greatest(so_far, c)
        out = out.withColumn(f"produccion_{d}", so_far)
        so_far = F.col(f"produccion_{d}")
    return out


def current_stock(products: DataFrame, product_keys: DataFrame, stock_keys: DataFrame) -> DataFrame:
    """Every product with the stock item that shares its best pair of keys.

    ``product_keys`` has product_id, match_key, product_key_type and product_priority, ``stock_keys`` match_key, stock_key_type,
    stock_priority and the columns of the stock row. The least sum of priorities wins, then the product's, the stock's, the item's
    name and its date, the latest. A product without any gets ``NO_STOCK``. Null keys match nothing. Whatever the product, of
    the stock rows of one key the same one is best: the others are left out before the join, so that a key adds one pair a product.
    """
    day = F.coalesce(-F.unix_date(F.to_date("stock_fecha_referencia")), F.lit(2**31 - 1)).alias("__day")
    order = ("stock_actual", "stock_key_type", *(c for c in NO_STOCK if c not in ("stock_item", "stock_actual", "stock_encontrado", "stock_match_status")))
    first = stock_keys.where("match_key IS NOT NULL").groupBy("match_key").agg(F.min(F.struct("stock_priority", "stock_item", day, *order, "stock_fecha_referencia")).alias("s")).select("match_key", "s.*")
    pairs = product_keys.dropDuplicates().join(first, "match_key").withColumns({"__score": F.col("product_priority") + F.col("stock_priority"), "stock_match_status": F.concat("product_key_type", F.lit("_vs_"), "stock_key_type"), "stock_encontrado": F.lit(True)})
    values = F.struct("__score", "product_priority", "stock_priority", "stock_item", "__day", *(c for c in NO_STOCK if c != "stock_item"), "stock_fecha_referencia")
    best = pairs.groupBy("product_id").agg(F.min(values).alias("b"))
    out = products.select("product_id").distinct().join(best, "product_id", "left")
    return out.select("product_id", *(F.coalesce(f"b.{c}", F.lit(v)).alias(c) for c, v in NO_STOCK.items()), F.col("b.stock_fecha_referencia").alias("stock_fecha_referencia"))


def stock_policy(policy: DataFrame, order: str) -> DataFrame:
    """Least and largest stock of a product from the filled template; its last row counts, by ``order``. No least stock is 0, no largest one none."""
    last = keep_best(policy, ["product_id"], F.desc(order))
    number = lambda c: finite(F.col(c).try_cast("double"))
    return last.select("product_id", F.coalesce(number("stock_minimo"), F.lit(0.0)).alias("stock_minimo"), number("stock_maximo").alias("stock_maximo"))


def adjusted_for_stock(predictions: DataFrame, stock: DataFrame, policy: DataFrame) -> DataFrame:
    """Predictions with stock, policy, projected stock, what has to be made, and both valued at the average cost (half to even)."""
    own = predictions.join(stock, "product_id", "left").join(policy, "product_id", "left")
    own = own.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (NO_STOCK | {"stock_minimo": 0.0}).items()})
    out = own.join(project_stock(own), ["product_id", "periodo"])
    value = lambda c: F.bround(F.col(c) * F.col("stock_avg_cost"), 2)
    return out.withColumns({"valor_stock_actual": value("stock_actual"), "valor_produccion_ajustada": value("cantidad_a_producir_ajustada")})


def policy_template(products: DataFrame, stock: DataFrame) -> DataFrame:
    """The template of stock policies: every product with its stock and blanks to fill."""
    rows = products.join(stock.select("product_id", "stock_actual", "stock_encontrado", "stock_match_status"), "product_id", "left")
    return rows.select(*products.columns, "stock_actual", "stock_encontrado", "stock_match_status", *(F.lit("").alias(c) for c in POLICY_BLANKS))


def expert_template(predictions: DataFrame, errors: DataFrame, most: int = 120) -> DataFrame:
    """The next month's ``most`` largest predictions with the product's errors and blanks for the experts' decision; ties by product."""
    nearest = predictions.agg(F.min("periodo").alias("m")).scalar()
    own = errors.select("source_type", "product_id", "error_absoluto_total", "wape_producto", "prioridad_revision")
    rows = predictions.where(F.col("periodo") == nearest).join(own, ["source_type", "product_id"], "left").withColumn("prioridad_revision", F.coalesce("prioridad_revision", F.lit("normal")))
    return rows.withColumns({c: F.lit("") for c in EXPERT_BLANKS}).orderBy(F.desc("cantidad_predicha"), "product_id").limit(most)
