"""Confidence, automation and recommendation of forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siembra.operators.relational import join_many_to_one


@dataclass(frozen=True)
class Thresholds:
    """Limits of the decision layer."""

    high_risk: float = 0.09
    medium_risk: float = 0.16
    std_weight: float = 1.0
    seasonal_penalty: float = 0.01
    priority_penalty: float = 0.01
    min_confidence: str = "media"
    allow_seasonal: bool = False


def operating_segment() -> Column:
    return F.when(F.col("estado_producto") == "inactivo", "inactivos").when(F.coalesce("es_estacional", F.lit(False)), "activos_estacionales").otherwise("activos_no_estacionales")


def decide(predictions: DataFrame, segments: DataFrame, errors: DataFrame, model_wape: float, t: Thresholds = Thresholds()) -> DataFrame:
    """Predictions with risk, band, confidence, review flag, automation flag and recommendation.

    ``segments`` has one row per segment (mean_wape, std_wape, share of good folds, verdict) and
    ``errors`` one per product; what they lack falls back to the model's WAPE.
    """
    p = join_many_to_one(predictions, errors.select("product_id", "error_absoluto_total", "wape_producto", "prioridad_revision"), ["product_id"])
    p = p.withColumn("segmento_operativo", operating_segment())
    s = segments.select(F.col("segmento").alias("segmento_operativo"), "segmento_apto_automatizacion", "mean_wape", "std_wape", "pct_folds_below_wape_threshold")
    p = join_many_to_one(p, s, ["segmento_operativo"])
    seasonal, active = F.coalesce("es_estacional", F.lit(False)), F.col("estado_producto") == "activo"
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(2.0))
    p = p.withColumns({
        "wape_producto": F.coalesce("wape_producto", F.lit(model_wape)),
        "prioridad_revision": F.coalesce("prioridad_revision", F.lit("normal")),
        "segmento_apto_automatizacion": F.coalesce("segmento_apto_automatizacion", F.lit(False)),
        "wape_segmento_walk_forward": F.coalesce("mean_wape", F.lit(model_wape)),
        "std_wape_segmento_walk_forward": F.coalesce("std_wape", F.lit(0.0)),
        "pct_folds_below_wape_threshold": F.coalesce("pct_folds_below_wape_threshold", F.lit(0.0)),
    }).drop("mean_wape", "std_wape")
    base = F.greatest(clip(F.col("wape_producto")), clip(F.col("wape_segmento_walk_forward") + F.col("std_wape_segmento_walk_forward") * t.std_weight), F.lit(model_wape))
    p = p.withColumn("riesgo_confianza_base", base)
    p = p.withColumn("riesgo_confianza_ajustado", clip(base + F.when(F.col("prioridad_revision") == "alta", t.priority_penalty).otherwise(0.0) + F.when(seasonal, t.seasonal_penalty).otherwise(0.0)))
    risk = F.col("riesgo_confianza_ajustado")
    confidence = F.when(F.col("estado_producto") == "inactivo", "no_aplica").when(risk <= t.high_risk, "alta").when(risk <= t.medium_risk, "media").otherwise("baja")
    p = p.withColumns({
        "prediccion_min": F.greatest(F.col("cantidad_predicha") * (1 - risk), F.lit(0.0)),
        "prediccion_max": F.col("cantidad_predicha") * (1 + risk),
        "confianza_prediccion": confidence,
    })
    review = ((F.col("confianza_prediccion") == "baja") | (F.col("prioridad_revision") == "alta") | seasonal) & (F.col("estado_producto") != "inactivo")
    enough = {"baja": ["baja", "media", "alta"], "media": ["media", "alta"], "alta": ["alta"]}[t.min_confidence]
    p = p.withColumns({"requiere_revision": review, "cumple_confianza_minima": F.col("confianza_prediccion").isin(*enough)})
    auto = active & F.col("cumple_confianza_minima") & F.col("segmento_apto_automatizacion") & ~F.col("requiere_revision")
    p = p.withColumn("apto_automatizacion", auto if t.allow_seasonal else auto & ~seasonal)
    advice = F.when(F.col("estado_producto") == "inactivo", "no producir por inactividad").when(F.col("apto_automatizacion"), "usar como cantidad sugerida").when(F.col("requiere_revision"), "revisar antes de ordenar").otherwise("revision por umbral operativo")
    rounded = {c: F.bround(c, 2) for c in ("cantidad_predicha", "prediccion_min", "prediccion_max", "riesgo_confianza_base", "riesgo_confianza_ajustado")}
    return p.withColumn("recomendacion_decision", advice).withColumns(rounded)


def review_list(decided: DataFrame, most: int = 120) -> DataFrame:
    """The next month's products to review, the largest errors first."""
    following = decided.agg(F.min("periodo").alias("m")).scalar()
    return decided.where((F.col("periodo") == following) & F.col("requiere_revision")).orderBy(F.desc(F.coalesce("error_absoluto_total", F.lit(0.0))), F.desc("cantidad_predicha"), "product_id").limit(most)


def planning_status() -> Column:
    """Label of a forecast row for planners; the first that holds."""
    return F.when(F.col("estado_producto") == "inactivo", "Inactivo").when(F.col("alerta_inventario") == "riesgo_quiebre_stock", "Riesgo de quiebre").when(F.col("alerta_inventario") == "sobrestock", "Sobrestock").when(F.col("requiere_revision"), "Revisar").when(F.col("apto_automatizacion"), "Listo").otherwise("Pendiente")


def uncertainty(df: DataFrame, ape: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Median absolute percentage errors by product, else by type, else over all, clipped."""
    by = lambda *k: ape.groupBy(*k).agg(F.median("ape").alias(f"ape_{len(k)}"))
    whole = ape.agg(F.median("ape").alias("m")).scalar()
    j = df.join(by("tipo", "product_id"), ["tipo", "product_id"], "left").join(by("tipo"), ["tipo"], "left")
    factor = F.least(F.greatest(F.coalesce("ape_2", "ape_1", whole, F.lit(low)), F.lit(low)), F.lit(high))
    return j.withColumn("factor", factor).withColumns({"banda_min": F.floor(F.col("cantidad_predicha") * (1 - F.col("factor"))), "banda_max": F.ceil(F.col("cantidad_predicha") * (1 + F.col("factor")))}).drop("ape_1", "ape_2")
