"""Routing, repairs, budgets, quality reports and catalogue paths of the commercial layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siembra.functions import text as X
from siembra.functions.numeric import safe_ratio
from siembra.operators.order_statistics import quantiles

#: Zones that stand for no zone.
EXCLUDED = r"\b(SIN|FALTA) ASIGNAR\b"


def assigned_zone(zone: str) -> Column:
    """Whether a zone is one: neither ``sin asignar`` nor ``falta asignar``."""
    return ~X.normalize_product_name(F.col(zone)).rlike(EXCLUDED)


def route_documents(df: DataFrame, kind: str, qty: str, value: str) -> DataFrame:
    """Quantities and values to sale, credit-note and return columns by document kind, as absolute numbers."""
    k = F.upper(F.coalesce(kind, F.lit("")))
    back, note = k.contains("NC DEV"), k.contains("NC") & ~k.contains("NC DEV")
    put = lambda when, c: F.when(when, F.abs(F.col(c))).otherwise(F.lit(0.0))
    sale = ~back & ~note
    return df.withColumns({f"{n}_{m}": put(w, c) for n, c in (("cant", qty), ("total", value)) for m, w in (("venta", sale), ("nc", note), ("devolucion", back))})


def repair_scale(df: DataFrame, qty: str, value: str, typical_price: str) -> DataFrame:
    """Quantities written a hundred times too large: multiples of 100 whose unit price is a hundredth of the usual."""
    price = F.when(F.col(qty) > 0, F.col(value) / F.col(qty))
    ratio = F.when(price > 0, F.col(typical_price) / price)
    wrong = (F.col(qty) >= 100) & (F.col(qty) % 100 == 0) & ratio.between(80, 120)
    return df.withColumns({qty: F.when(wrong, F.col(qty) / 100).otherwise(F.col(qty)), "escala_corregida": F.coalesce(wrong, F.lit(False))})


def first_positive(*columns: str) -> Column:
    """The first column above 0; 0 without any."""
    return F.coalesce(*(F.when(F.col(c) > 0, F.col(c)) for c in columns), F.lit(0.0))


def first_key(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns))


def budget(df: DataFrame, net: str, returns: str, sales: str, zone_factor: Column, target: float = 0.85) -> DataFrame:
    """Budget of net / target by zone, a penalty for returns above 5 %, attainment and traffic light."""
    rate = safe_ratio(F.col(returns), F.col(sales))
    planned = F.col(net) / target * zone_factor * F.when(rate > 0.05, 1 + rate).otherwise(1.0)
    reached = safe_ratio(F.col(net), planned) * 100
    light = F.when(reached >= 95, "VERDE").when(reached >= 80, "AMARILLO").otherwise("ROJO")
    return df.withColumns({"presupuesto": planned, "cumplimiento": reached, "semaforo": light})


def quality_report(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Long table (regla, valor): rows, missing, negative, zero, quartile outliers, duplicates, largest ratio to the median."""
    q = quantiles(df, value, [0.25, 0.5, 0.75]).scalar()
    v, width = F.col(value), q[2] - q[0]
    facts = df.agg(
        F.count("*").cast("double").alias("filas"), F.count_if(v.isNull()).cast("double").alias("faltantes"), F.count_if(v < 0).cast("double").alias("negativos"), F.count_if(v == 0).cast("double").alias("ceros"),
        F.count_if((v < q[0] - width * 1.5) | (v > q[2] + width * 1.5)).cast("double").alias("atipicos"), F.coalesce(F.max(F.when(q[1] > 0, v / q[1])), F.lit(0.0)).alias("razon_maxima"),
    )
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("duplicados")).scalar()
    wide = facts.withColumn("duplicados", repeated)
    return wide.unpivot([], wide.columns, "regla", "valor")


def quality_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two quality reports by rule: difference and whether fewer problems are left."""
    j = before.withColumnRenamed("valor", "antes").join(after.withColumnRenamed("valor", "despues"), "regla", "full_outer")
    change = F.coalesce("despues", F.lit(0.0)) - F.coalesce("antes", F.lit(0.0))
    return j.withColumn("cambio", change).withColumn("veredicto", F.when(F.col("cambio") < 0, "MEJORA").when(F.col("cambio") > 0, "EMPEORA").otherwise("IGUAL"))


def canonical_path(c: Column) -> Column:
    """(tipo, categoria, base) of a colon path: repeated neighbouring parts once, EXTR as EXT, articles dropped."""
    parts = F.transform(F.split(X.clean_string(c), "[:>]"), lambda p: X.normalize_product_name(p))
    plain = F.transform(parts, lambda p: X.squeeze(F.regexp_replace(F.regexp_replace(p, r"\bEXTR\b", "EXT"), r"\b(EL|LA|LOS|LAS|DE|DEL)\b", " ")))
    kept = F.filter(plain, lambda p, i: (p != "") & ((i == 0) | (p != F.element_at(plain, F.greatest(i, F.lit(1))))))
    return F.struct(X.product_type(c).alias("tipo"), F.coalesce(F.try_element_at(kept, F.lit(-2)), F.lit("")).alias("categoria"), F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")).alias("base"))


def modal_labels(df: DataFrame, base: str, label: str) -> DataFrame:
    """The most frequent label of every base name, the smallest of equals."""
    return df.groupBy(base).agg(F.mode(F.nullif(F.col(label), F.lit("")), True).alias(label))


def cumulative_segments(df: DataFrame, key: str, qty: str, shares: Sequence[float] = (0.2, 0.5, 0.8)) -> DataFrame:
    """Share of the volume that larger products and this one make, and the segments by it.

    Products are ordered by volume within ranges of its logarithm; sums above a range are combined first.
    """
    exact = F.col(qty).cast("decimal(24,6)")
    placed = df.withColumn("__range", F.floor(F.log2(F.greatest(F.col(qty), F.lit(0.0)) + 1) * 64))
    sums = placed.groupBy("__range").agg(F.sum(exact).alias("__n"))
    above = sums.select("__range", F.sum("__n").over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("__above"))
    inside = F.sum(exact).over(Window.partitionBy("__range").orderBy(F.desc(qty), key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = df.agg(F.sum(exact).alias("t")).scalar()
    out = placed.withColumn("__in", inside).join(above, "__range")
    share = F.when(total > 0, (F.coalesce("__above", F.lit(0).cast("decimal(34,6)")) + F.col("__in")).cast("double") / total.cast("double")).otherwise(F.lit(0.0))
    out = out.withColumn("acumulado", share)
    return out.withColumns({f"top_{round(s * 100)}": F.col("acumulado") <= s for s in shares}).drop("__range", "__in", "__above")


def keep_last(df: DataFrame, keys: Sequence[str], date: str, ordinal: str) -> DataFrame:
    """The last row of a key by date (no date first), then by its place in the source."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(date), F.desc(ordinal))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
