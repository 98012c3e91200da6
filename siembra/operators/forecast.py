"""Regression protocol over the monthly panel: fit, select, backtest, forecast recursively.

Tree ensembles are MLlib's: random forests in two settings and boosted trees; linear models with and
without a penalty. Histogram boosting and SGD have no MLlib twin; their places are taken by boosted trees and the
penalised linear model. Extremely randomised trees are in ``extra_trees``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siembra.functions.numeric import history_cap
from siembra.operators.metrics import best_model, error_metrics, holdout, periods_of, rolling_origin, segment_flags, walk_forward, walk_forward_summary
from siembra.operators.panel import feature_matrix

# Names of the features, and the published settings of the models below.
FEATURES = ["lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_mean_3", "rolling_mean_6", "rolling_mean_12", "rolling_max_12", "nonzero_6", "nonzero_12", "expanding_mean", "expanding_max", "months_since_first", "month", "quarter", "year", "month_sin", "month_cos", "share_top_3_meses", "seasonal_month_flag"]
BASELINES = ("lag_1", "lag_12", "hybrid")


def models(seed: int = 42) -> dict[str, object]:
    common = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__p"}
    return {
        "linear": LinearRegression(**common),
        "ridge": LinearRegression(**common, regParam=1.0, elasticNetParam=0.0),
        "elastic_net": LinearRegression(**common, regParam=0.1, elasticNetParam=0.5),
        "random_forest": RandomForestRegressor(**common, numTrees=40, maxDepth=8, minInstancesPerNode=3, featureSubsetStrategy="all", seed=seed),
        "random_forest_conservative": RandomForestRegressor(**common, numTrees=40, maxDepth=6, minInstancesPerNode=10, featureSubsetStrategy="all", seed=seed),
        "boosted_trees": GBTRegressor(**common, maxIter=30, maxDepth=5, stepSize=0.06, seed=seed),
    }


def prepared(panel: DataFrame) -> DataFrame:
    """The feature matrix without gaps: absent history counts as 0."""
    df = feature_matrix(panel)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def trainable(df: DataFrame) -> DataFrame:
    """Without the months after an inactive product's last activity."""
    return df.where(~((F.col("estado_producto") == "inactivo") & (F.col("ultima_actividad").isNotNull()) & (F.col("periodo") > F.col("ultima_actividad"))))


def active_features(df: DataFrame, columns: Sequence[str] = FEATURES) -> list[str]:
    """Columns that aren't zero everywhere."""
    sums = df.agg(*(F.sum(F.abs(F.col(c))).alias(c) for c in columns)).first().asDict()
    return [c for c in columns if sums[c]]


def fit(df: DataFrame, model: object, columns: Sequence[str]) -> PipelineModel:
    """A model of log1p of the target."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x"), model]).fit(df.withColumn("__y", F.log1p(F.greatest(F.col("target_qty"), F.lit(0.0)))))


def predict(df: DataFrame, model: PipelineModel, name: str = "prediccion") -> DataFrame:
    """Back from the logarithm, at most three times what the product's history has seen."""
    raw = F.expm1(F.least(F.col("__p"), F.lit(50.0)))
    return model.transform(df).withColumn(name, history_cap(raw, F.col("expanding_max"), F.col("rolling_max_12"), F.col("rolling_mean_12"))).drop("__x", "__p")


def baselines(df: DataFrame) -> DataFrame:
    """Last month, same month of last year and the mean of what there is of both."""
    year = F.when(F.col("lag_12") > 0, F.col("lag_12"))
    return df.withColumns({"lag_1_pred": F.coalesce("lag_1", F.lit(0.0)), "lag_12_pred": F.coalesce("lag_12", F.lit(0.0)), "hybrid_pred": F.coalesce((F.col("lag_1") + year) / 2, "lag_1", F.lit(0.0))})


def compare_models(features: DataFrame, months: Sequence[date] | None = None, names: Sequence[str] | None = None, folds: int = 3) -> tuple[DataFrame, str]:
    """Temporal cross-validation before the test months: metrics by model, and the model it selects."""
    months = months or periods_of(features)
    split = holdout(months)
    before_test = [*split["train"], *split["validation"]]
    known = models()
    columns = active_features(features.where(F.col("periodo").isin(before_test)))
    rows = None
    for name in names or known:
        for k, (train, validation) in enumerate(rolling_origin(before_test, folds)):
            model = fit(trainable(features.where(F.col("periodo").isin(train))), known[name], columns)
            scored = predict(features.where(F.col("periodo").isin(validation)), model).agg(*error_metrics("target_qty", "prediccion")).withColumns({"model_name": F.lit(name), "fold": F.lit(k)})
            rows = scored if rows is None else rows.unionByName(scored)
    table = rows.groupBy("model_name").agg(F.avg("wape").alias("wape"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.count("*").alias("folds")).cache()
    return table, best_model({r["model_name"]: r["wape"] for r in table.collect()}, "validation")


def backtest(features: DataFrame, name: str, windows: int = 6) -> tuple[DataFrame, DataFrame]:
    """Walk-forward errors by fold and segment, and their summary."""
    columns = active_features(features)
    rows = None
    for k, (train, test) in enumerate(walk_forward(periods_of(features), windows)):
        model = fit(trainable(features.where(F.col("periodo").isin(train))), models()[name], columns)
        e = segment_flags(predict(features.where(F.col("periodo").isin(test)), model)).groupBy("segmento").agg(*error_metrics("target_qty", "prediccion")).withColumn("fold", F.lit(k))
        rows = e if rows is None else rows.unionByName(e)
    return rows, walk_forward_summary(rows)


def forecast(panel: DataFrame, model: PipelineModel, horizon: int = 6) -> DataFrame:
    """Month by month: a prediction becomes history for the next; inactive products get 0.

    Every step cuts its lineage by checkpoint(), which goes to the folder of spark.checkpoint.dir.
    """
    history = panel.select("product_id", "periodo", "target_qty")
    last = periods_of(panel)[-1]
    out = None
    for k in range(1, horizon + 1):
        step = history.select("product_id").distinct().select("product_id", F.add_months(F.lit(last), k).alias("periodo"), F.lit(None).cast("double").alias("target_qty"))
        features = prepared(history.unionByName(step)).where(F.col("periodo") == F.add_months(F.lit(last), k))
        made = predict(features, model, "cantidad_predicha")
        inactive = F.col("estado_producto") == "inactivo"
        made = made.select("product_id", "periodo", "estado_producto", "es_estacional", F.when(inactive, 0.0).otherwise(F.col("cantidad_predicha")).alias("cantidad_predicha"), F.when(inactive, "inactive_zero_rule").otherwise("model").alias("prediction_rule")).checkpoint()
        history = history.unionByName(made.select("product_id", "periodo", F.col("cantidad_predicha").alias("target_qty")))
        out = made if out is None else out.unionByName(made)
    return out


def importance(df: DataFrame, model: PipelineModel, columns: Sequence[str], seed: int = 42) -> dict[str, float]:
    """Loss of WAPE when a column is replaced by another row's value of it (permutation by a hash join)."""
    base = predict(df, model).agg(*error_metrics("target_qty", "prediccion")).first()["wape"]
    n = df.count()
    numbered = df.withColumn("__k", F.pmod(F.xxhash64("product_id", "periodo", F.lit(seed)), F.lit(max(1, n))))
    out = {}
    for c in columns:
        mean = df.agg(F.avg(c).alias("m")).scalar()
        other = numbered.select(F.pmod(F.col("__k") + 1, F.lit(max(1, n))).alias("__k"), F.col(c).alias("__v")).dropDuplicates(["__k"])
        moved = numbered.join(other, "__k", "left").withColumn(c, F.coalesce("__v", mean)).drop("__v")
        out[c] = predict(moved, model).agg(*error_metrics("target_qty", "prediccion")).first()["wape"] - base
    return out
