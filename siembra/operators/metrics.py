"""Error metrics, segments, folds, drift and plan comparison."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siembra.functions.numeric import safe_ratio
from siembra.operators.order_statistics import quantiles, value_ranks
from siembra.operators.relational import average_rank
from siembra.sources.scratch import written


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(24,6)")).cast("double")


def error_metrics(actual: str, predicted: str) -> list[Column]:
    """MAE, RMSE, sMAPE (0 where both are 0), WAPE (0 without actuals) and bias in percent."""
    y, p = F.col(actual), F.col(predicted)
    e = F.abs(y - p)
    smape = F.when(F.abs(y) + F.abs(p) > 0, 2 * e / (F.abs(y) + F.abs(p))).otherwise(F.lit(0.0))
    return [
        F.avg(e).alias("mae"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"), F.avg(smape).alias("smape"),
        safe_ratio(_exact(e), _exact(y)).alias("wape"), (safe_ratio(_exact(p - y), _exact(F.abs(y))) * 100).alias("bias_pct"), F.count("*").alias("n"),
    ]


def high_error_products(df: DataFrame, key: str, actual: str, predicted: str, share: float = 0.2) -> DataFrame:
    """Errors of products; the top share by absolute error has priority ``alta``."""
    e = F.abs(F.col(actual) - F.col(predicted))
    g = df.groupBy(key).agg(_exact(F.col(actual)).alias("cantidad_real_total"), _exact(F.col(predicted)).alias("cantidad_predicha_total"), _exact(e).alias("error_absoluto_total"))
    g = g.withColumn("wape_producto", safe_ratio(F.col("error_absoluto_total"), F.col("cantidad_real_total")))
    # an average rank below share: counted by distinct error values, which are combined first
    g = written(g, "errors")
    ranked = value_ranks(g, "error_absoluto_total")
    rank = (F.col("total") - F.col("below") - F.col("n") + 1 + (F.col("n") - 1) / 2.0) / F.col("total")
    ranked = ranked.select("error_absoluto_total", F.when(rank <= share, "alta").otherwise("normal").alias("prioridad_revision"))
    return g.join(ranked, "error_absoluto_total", "left").withColumn("prioridad_revision", F.coalesce("prioridad_revision", F.lit("normal")))


def dedupe_high_error(df: DataFrame, key: str = "product_id") -> DataFrame:
    """One row per product: errors and actuals summed, the ratio of both, alta if any row is."""
    g = df.groupBy(key).agg(_exact(F.col("cantidad_real_total")).alias("cantidad_real_total"), _exact(F.col("error_absoluto_total")).alias("error_absoluto_total"), F.max("wape_producto").alias("__most"), F.max((F.col("prioridad_revision") == "alta").cast("int")).alias("__alta"))
    wape = F.when(F.col("cantidad_real_total") > 0, F.col("error_absoluto_total") / F.col("cantidad_real_total")).otherwise(F.col("__most"))
    return g.withColumns({"wape_producto": wape, "prioridad_revision": F.when(F.col("__alta") == 1, "alta").otherwise("normal")}).drop("__most", "__alta")


def segment_flags(df: DataFrame, active: str = "estado_producto", seasonal: str = "es_estacional") -> DataFrame:
    """Every row once for each segment it belongs to."""
    act, sea = F.col(active) == "activo", F.coalesce(F.col(seasonal), F.lit(False))
    names = F.filter(F.array(F.lit("global"), F.when(act, "activos"), F.when(~act, "inactivos"), F.when(act & sea, "activos_estacionales"), F.when(act & ~sea, "activos_no_estacionales")), lambda x: x.isNotNull())
    return df.withColumn("segmento", F.explode(names))


def walk_forward_summary(errors: DataFrame, fold: str = "fold", most_wape: float = 0.10, most_std: float = 0.03, least_share: float = 0.67) -> DataFrame:
    """Segment errors over folds, and whether a segment may run without review."""
    return errors.groupBy("segmento").agg(F.avg("wape").alias("mean_wape"), F.coalesce(F.stddev_samp("wape"), F.lit(0.0)).alias("std_wape"), F.min("wape").alias("min_wape"), F.max("wape").alias("max_wape"), F.avg((F.col("wape") <= most_wape).cast("double")).alias("pct_folds_below_wape_threshold"), F.countDistinct(fold).alias("folds")).withColumn(
        "segmento_apto_automatizacion", (F.col("mean_wape") <= most_wape) & (F.col("std_wape") <= most_std) & (F.col("pct_folds_below_wape_threshold") >= least_share)
    )


def periods_of(df: DataFrame, month: str = "periodo") -> list[date]:
    """The distinct months in order: bounded by the length of history."""
    return [r[0] for r in df.select(month).distinct().orderBy(month).collect()]


def holdout(months: Sequence[date], test: int = 3, validation: int = 3) -> dict[str, list[date]]:
    if len(months) <= test + validation:
        raise ValueError("too few months")
    return {"train": list(months[: -test - validation]), "validation": list(months[-test - validation : -test]), "test": list(months[-test:])}


def rolling_origin(months: Sequence[date], folds: int = 3, size: int = 3) -> list[tuple[list[date], list[date]]]:
    """(train, validation) of consecutive blocks at the end; training always ends before."""
    out = []
    for k in range(folds, 0, -1):
        end = len(months) - (k - 1) * size
        if end - size > 0:
            out.append((list(months[: end - size]), list(months[end - size : end])))
    return out


def walk_forward(months: Sequence[date], windows: int = 6, step: int = 1, size: int = 3) -> list[tuple[list[date], list[date]]]:
    """(train, test) windows that move by ``step`` months and end with the last one."""
    out = []
    for k in range(windows - 1, -1, -1):
        end = len(months) - k * step
        if end - size > 0:
            out.append((list(months[: end - size]), list(months[end - size : end])))
    return out


def fraction_split(months: Sequence[date], train: float = 0.6, validation: float = 0.2) -> dict[str, list[date]]:
    a, b = int(len(months) * train), int(len(months) * (train + validation))
    return {"train": list(months[:a]), "validation": list(months[a:b]), "test": list(months[b:])}


def best_model(scores: dict[str, float], selected_on: str) -> str:
    """The model of the lowest WAPE; a choice on test months is refused."""
    if selected_on == "test":
        raise ValueError("models can't be selected on the test months")
    return min(scores, key=lambda k: (scores[k], k))


def psi(train: DataFrame, test: DataFrame, value: str, bins: int = 10) -> float:
    """Population stability index over quantile bins of the training values; 0 with less than three edges."""
    edges = sorted(set(quantiles(train, value, [k / bins for k in range(bins + 1)]).first()["q"] or []))
    if len(edges) < 3:
        return 0.0
    place = sum(((F.col(value) > e).cast("int") for e in edges[1:-1]), F.lit(0))
    share = lambda df: {r["b"]: r["n"] for r in df.where(F.col(value).isNotNull()).groupBy(place.alias("b")).count().withColumnRenamed("count", "n").collect()}
    a, b = share(train), share(test)
    na, nb = max(1, sum(a.values())), max(1, sum(b.values()))
    import math

    return sum((max(x, 1e-6) - max(y, 1e-6)) * math.log(max(x, 1e-6) / max(y, 1e-6)) for x, y in ((a.get(k, 0) / na, b.get(k, 0) / nb) for k in range(len(edges) - 1)))


def plan_quality(df: DataFrame, plan: str, made: str) -> DataFrame:
    """How often a plan is met exactly or within 5 %, its correlation with what was made and its WAPE."""
    close = F.abs(F.col(plan) - F.col(made)) <= 0.05 * F.abs(F.col(made))
    return df.agg(F.avg((F.col(plan) == F.col(made)).cast("double")).alias("exactos"), F.avg(close.cast("double")).alias("dentro_5"), F.corr(plan, made).alias("correlacion"), safe_ratio(_exact(F.abs(F.col(plan) - F.col(made))), _exact(F.col(made))).alias("wape"), (F.countDistinct(plan) > 1).alias("informativo"))


__all__ = ["average_rank", "best_model", "dedupe_high_error", "error_metrics", "fraction_split", "high_error_products", "holdout", "periods_of", "plan_quality", "psi", "rolling_origin", "segment_flags", "walk_forward", "walk_forward_summary"]
