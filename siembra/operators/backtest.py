"""Walk-forward backtests and learning curves: one pass for the sums, one to score every window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siembra.functions.numeric import history_cap, safe_ratio
from siembra.operators import extra_trees as ET
from siembra.operators import least_squares as LS
from siembra.operators.forecast import baselines, fit, models, predict, trainable
from siembra.operators.metrics import best_model, error_metrics, holdout, periods_of, rolling_origin, walk_forward
from siembra.sources.scratch import written

#: Ridge penalty of each linear model. Fixed values.
PENALTIES = {"linear_regression": 0.0, "ridge_regression": 1.0}
BASELINES = ("lag_1", "lag_12", "hybrid")


def _literal(windows: Sequence[dict]) -> Column:
    """An array of structs of plain values: the windows, a few dozen at most."""

    def lit(value: object) -> Column:
        return F.array(*(F.lit(float(x)) for x in value)) if isinstance(value, (list, np.ndarray)) else F.lit(value)

    return F.array(*(F.struct(*(lit(v).alias(k) for k, v in w.items())) for w in windows))


def _predicted(raw: Column) -> Column:
    """Back from the logarithm, capped by the product's history."""
    return history_cap(F.expm1(F.least(raw, F.lit(50.0))), F.col("expanding_max"), F.col("rolling_max_12"), F.col("rolling_mean_12"))


def linear_windows(features: DataFrame, columns: Sequence[str], cuts: Sequence[dict], names: Sequence[str] = tuple(PENALTIES), least_rows: int = 1) -> list[dict]:
    """Intercept and slopes of each model for each cut (a dict with ``train_until``); cuts with too few rows fall out."""
    moments = LS.monthly_moments(trainable(features), columns, F.log1p(F.greatest(F.col("target_qty"), F.lit(0.0))))
    out = []
    for cut in cuts:
        total = LS.until(moments, cut["train_until"])
        if total is None or total.rows < least_rows:
            continue
        for name in names:
            intercept, slopes = total.solve(PENALTIES[name])
            out.append(cut | {"model_name": name, "train_rows": total.rows, "intercept": intercept, "slopes": slopes})
    return out


def folds(months: Sequence[date], windows: int = 6, step: int = 1, size: int = 3) -> list[dict]:
    """Test windows of ``size`` months that move by ``step`` and end with the last month."""
    return [{"fold_id": k, "train_until": train[-1], "test_from": test[0], "test_until": test[-1]} for k, (train, test) in enumerate(walk_forward(months, windows, step, size), 1) if train]


def with_segments(rows: DataFrame, by: Sequence[str] = ("fold_id", "model_name")) -> DataFrame:
    """Every row once for each of the nine segments that it belongs to.

    The products of the top 20 and 50 percent are those up to which the share of the fold's volume, from the
    largest down, stays at or below it; equal volumes go by product. Shares are summed by ranges of
    volume first, and row by row only within a range.
    """
    by = list(by)
    segments = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in _segments().items())), lambda s: s.isNotNull())
    return rows.join(volume_shares(rows, by), [*by, "product_id"]).withColumn("segmento", F.explode(segments)).drop("cum_share")


def volume_shares(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, product_id, cum_share): the share of the volume from the largest product down to each."""
    by = list(by)
    volume = rows.groupBy(*by, "product_id").agg(F.sum(F.col("target_qty").cast("decimal(24,6)")).alias("v"))
    placed = volume.withColumn("range", F.when(F.col("v") > 0, F.floor(F.log2(F.col("v").cast("double")) * 32)))
    ranges = placed.groupBy(*by, "range").agg(F.sum("v").alias("rv"))
    down = Window.partitionBy(*by).orderBy(F.desc_nulls_last("range"))
    ranges = ranges.withColumns({"above": F.coalesce(F.sum("rv").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("rv").over(Window.partitionBy(*by))})
    inside = F.sum("v").over(Window.partitionBy(*by, "range").orderBy(F.desc("v"), "product_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = ranges.select(*(F.col(c).alias(f"r_{c}") for c in (*by, "range")), "above", "all")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in (*by, "range")))
    share = placed.join(ranges, same).withColumn("through", F.col("above") + inside)
    return share.select(*by, "product_id", F.when(F.col("all") > 0, F.col("through") / F.col("all")).otherwise(F.lit(0)).cast("double").alias("cum_share"))


def _segments() -> dict[str, Column]:
    active, seasonal = F.col("estado_producto") == "activo", F.coalesce(F.col("es_estacional"), F.lit(False))
    return {
        "todos": F.lit(True), "activos": active, "inactivos": F.col("estado_producto") == "inactivo", "estacionales": seasonal, "no_estacionales": ~seasonal,
        "activos_estacionales": active & seasonal, "activos_no_estacionales": active & ~seasonal, "top_20pct_volumen": F.col("cum_share") <= 0.2, "top_50pct_volumen": F.col("cum_share") <= 0.5,
    }


def walk_forward_backtest(features: DataFrame, columns: Sequence[str], windows: int = 6, step: int = 1, size: int = 3, models: Sequence[str] = tuple(PENALTIES), least_rows: int = 1) -> DataFrame:
    """Predictions of each fold and model for its test months: linear models refitted at each cut, and the three baselines.

    A fold trains on all months before its test months. ``features`` should be a written table: it is read for the
    sums and once more for the scores, however many windows there are. No months or too few give no rows.
    """
    cuts = folds(periods_of(features), windows, step, size)
    fits = linear_windows(features, columns, cuts, models, least_rows)
    kept = ["product_id", "periodo", "target_qty", "estado_producto", "es_estacional"]
    if not fits:
        return features.limit(0).select(*kept, F.lit(0).alias("fold_id"), F.lit("").alias("model_name"), F.lit(0.0).alias("prediccion"))
    table = _literal([{k: w[k] for k in ("fold_id", "model_name", "test_from", "test_until", "intercept", "slopes")} for w in fits])
    inside = F.col("periodo").between(F.col("w.test_from"), F.col("w.test_until"))
    test = features.where(F.col("periodo") >= min(w["test_from"] for w in fits))
    scored = test.withColumn("w", F.explode(table)).where(inside).select(*kept, F.col("w.fold_id").alias("fold_id"), F.col("w.model_name").alias("model_name"), _predicted(LS.fitted(F.col("w.intercept"), F.col("w.slopes"), columns)).alias("prediccion"))
    return scored.unionByName(_naive(test, fits, kept))


def baseline_backtest(features: DataFrame, windows: int = 6, step: int = 1, size: int = 3) -> DataFrame:
    """The three baselines' part of ``walk_forward_backtest``: nothing is fitted, and of the features lag_1 and lag_12 suffice."""
    cuts = folds(periods_of(features), windows, step, size)
    kept = ["product_id", "periodo", "target_qty"]
    if not cuts:
        return features.limit(0).select(*kept, F.lit(0).alias("fold_id"), F.lit("").alias("model_name"), F.lit(0.0).alias("prediccion"))
    return _naive(features.where(F.col("periodo") >= min(c["test_from"] for c in cuts)), cuts, kept)


def _naive(test: DataFrame, cuts: Sequence[dict], kept: Sequence[str]) -> DataFrame:
    plain = _literal([{"fold_id": k, "test_from": a, "test_until": b} for k, a, b in sorted({(w["fold_id"], w["test_from"], w["test_until"]) for w in cuts})])
    inside = F.col("periodo").between(F.col("w.test_from"), F.col("w.test_until"))
    simple = F.explode(F.array(*(F.struct(F.lit(name).alias("model_name"), F.col(f"{name}_pred").alias("prediccion")) for name in BASELINES)))
    return baselines(test).withColumn("w", F.explode(plain)).where(inside).select(*kept, F.col("w.fold_id").alias("fold_id"), simple.alias("s")).select(*kept, "fold_id", "s.*")


def fold_errors(predictions: DataFrame, by: Sequence[str] = ("fold_id", "model_name")) -> DataFrame:
    """``error_metrics`` by model, fold and segment; ``by`` may be the fold alone if all models predict the same rows.

    Rows are added up by the set of segments that they belong to, and only these sums go to each segment.
    """
    y, p = F.col("target_qty"), F.col("prediccion")
    e, names = F.abs(y - p), _segments()
    exact = lambda c: F.sum(c.cast("decimal(24,6)"))
    belongs = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(names.values())), F.lit(0))
    smape = F.when(F.abs(y) + F.abs(p) > 0, 2 * e / (F.abs(y) + F.abs(p))).otherwise(F.lit(0.0))
    rows = predictions.join(volume_shares(predictions, by), [*by, "product_id"]).select("model_name", "fold_id", "target_qty", "prediccion", belongs.alias("belongs"))
    sums = rows.groupBy("model_name", "fold_id", "belongs").agg(
        F.count("*").alias("n"), F.count(e).alias("known"), F.sum(e).alias("e"), F.sum((y - p) ** 2).alias("ee"), F.sum(smape).alias("s"), exact(e).alias("xe"), exact(y).alias("xy"), exact(p - y).alias("xd"), exact(F.abs(y)).alias("xa"),
    )
    segment = F.explode(F.filter(F.array(*(F.when(F.col("belongs").bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(names))), lambda s: s.isNotNull()))
    total = lambda c: F.sum(c).cast("double")
    return sums.withColumn("segmento", segment).groupBy("model_name", "fold_id", "segmento").agg(
        (F.sum("e") / F.sum("known")).alias("mae"), F.sqrt(F.sum("ee") / F.sum("known")).alias("rmse"), (F.sum("s") / F.sum("n")).alias("smape"),
        safe_ratio(total("xe"), total("xy")).alias("wape"), (safe_ratio(total("xd"), total("xa")) * 100).alias("bias_pct"), F.sum("n").alias("n"),
    )


def stability(errors: DataFrame, most_wape: float = 0.10, most_std: float = 0.03, least_share: float = 0.67, seasonal_auto: bool = False) -> DataFrame:
    """Errors of a segment over folds and whether it may run without review; seasonal segments only if allowed."""
    out = errors.groupBy("model_name", "segmento").agg(
        F.countDistinct("fold_id").alias("folds"), F.sum("n").alias("rows_total"), F.avg("wape").alias("mean_wape"), F.coalesce(F.stddev_samp("wape"), F.lit(0.0)).alias("std_wape"), F.max("wape").alias("max_wape"), F.min("wape").alias("min_wape"),
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.avg((F.col("wape") <= most_wape).cast("double")).alias("pct_folds_below_wape_threshold"),
    )
    fit = (F.col("mean_wape") <= most_wape) & (F.col("std_wape") <= most_std) & (F.col("pct_folds_below_wape_threshold") >= least_share)
    return out.withColumn("segmento_apto_automatizacion", fit if seasonal_auto else fit & ~F.col("segmento").isin("estacionales", "activos_estacionales"))


def curve_cuts(train: Sequence[date], points: int = 8, least_share: float = 0.2) -> list[dict]:
    """Ends of ever longer training periods, from a share of the months to all of them."""
    if len(train) < 2:
        return []
    first = max(0, int((len(train) - 1) * least_share))
    places = sorted({int(x) for x in np.linspace(first, len(train) - 1, max(2, points))})
    return [{"curve_point": k, "train_until": train[p], "train_periods": p + 1} for k, p in enumerate(places, 1)]


def learning_curve(features: DataFrame, columns: Sequence[str], model: str = "ridge_regression", points: int = 8, least_share: float = 0.2, least_rows: int = 1) -> DataFrame:
    """Errors in training and in the validation months by length of the training period, and their gap.

    The test months take no part. All points come from the same sums and one scoring pass.
    """
    split = holdout(periods_of(features))
    fits = linear_windows(features, columns, curve_cuts(split["train"], points, least_share), [model], least_rows)
    if not fits:
        raise ValueError("too few rows to train")
    low, high = split["validation"][0], split["validation"][-1]
    table = _literal([{k: w[k] for k in ("curve_point", "train_until", "train_periods", "train_rows", "intercept", "slopes")} for w in fits])
    inactive = (F.col("estado_producto") == "inactivo") & F.col("ultima_actividad").isNotNull() & (F.col("periodo") > F.col("ultima_actividad"))
    rows = features.where(F.col("periodo") <= high).withColumn("w", F.explode(table))
    part = F.when(F.col("periodo").between(F.lit(low), F.lit(high)), "validation").when((F.col("periodo") <= F.col("w.train_until")) & ~F.coalesce(inactive, F.lit(False)), "train")
    scored = rows.select("w.curve_point", "w.train_until", "w.train_periods", "w.train_rows", part.alias("part"), "target_qty", _predicted(LS.fitted(F.col("w.intercept"), F.col("w.slopes"), columns)).alias("p")).where("part IS NOT NULL")
    keys = ["curve_point", "train_until", "train_periods", "train_rows"]
    errors = scored.groupBy(*keys, "part").agg(*error_metrics("target_qty", "p"))
    pick = lambda m, part: F.max(F.when(F.col("part") == part, F.col(m)))
    wide = errors.groupBy(*keys).agg(*(pick(m, part).alias(f"{m}_{part}") for m in ("wape", "mae", "rmse", "smape") for part in ("train", "validation")), pick("n", "validation").alias("validation_rows"))
    return wide.withColumns({"model_name": F.lit(model), "wape_gap": F.col("wape_validation") - F.col("wape_train")})


def compare_models(features: DataFrame, columns: Sequence[str], folds: int = 3, trees: int = 40, depth: int = 8) -> tuple[DataFrame, str]:
    """Six models by temporal cross-validation before the test months: errors averaged over folds, and the one of least WAPE.

    Linear and ridge of all folds come from the same sums, the randomised trees of all folds from the same passes;
    the two forests and the boosted trees are fitted fold by fold. The test months are neither trained on
    nor validated on, so the choice can't depend on them. ``features`` should be a written table.
    """
    split = holdout(periods_of(features))
    before = [*split["train"], *split["validation"]]
    cuts = [{"fold_id": k, "train_until": train[-1], "test_from": test[0], "test_until": test[-1]} for k, (train, test) in enumerate(rolling_origin(before, folds), 1)]
    train = trainable(features)
    target = F.log1p(F.greatest(F.col("target_qty"), F.lit(0.0)))
    fits = _literal(linear_windows(features, columns, cuts))
    inside = F.col("periodo").between(F.col("w.test_from"), F.col("w.test_until"))
    scored = features.withColumn("w", F.explode(fits)).where(inside).select("w.model_name", "w.fold_id", "target_qty", _predicted(LS.fitted(F.col("w.intercept"), F.col("w.slopes"), columns)).alias("p"))
    forest = ET.fit(train, columns, target, [c["train_until"] for c in cuts], trees, depth)
    known = models()
    for k, cut in enumerate(cuts):
        test = features.where(F.col("periodo").between(F.lit(cut["test_from"]), F.lit(cut["test_until"])))
        own = ET.predict(test, forest, columns, k).select(F.lit("extra_trees").alias("model_name"), F.lit(cut["fold_id"]).alias("fold_id"), "target_qty", _predicted(F.col("raw")).alias("p"))
        scored = scored.unionByName(own)
        for name in ("random_forest", "random_forest_conservative", "boosted_trees"):
            model = fit(train.where(F.col("periodo") <= F.lit(cut["train_until"])), known[name], columns)
            scored = scored.unionByName(predict(test, model, "p").select(F.lit(name).alias("model_name"), F.lit(cut["fold_id"]).alias("fold_id"), "target_qty", "p"))
    errors = scored.groupBy("model_name", "fold_id").agg(*error_metrics("target_qty", "p"))
    table = written(errors.groupBy("model_name").agg(F.avg("wape").alias("wape"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.count("*").alias("folds")), "models")
    return table, best_model({r["model_name"]: r["wape"] for r in table.collect()}, "validation")
