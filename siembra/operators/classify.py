"""Return-risk classifier, rule benchmarks and stability of outlier methods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siembra.operators.metrics import periods_of
from siembra.operators.mining import isolation_forest


def temporal_split(df: DataFrame, month: str = "periodo", share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The last fifth of the periods is for the test; with one period rows are drawn by hash."""
    months = periods_of(df, month)
    if len(months) < 2:
        test = F.pmod(F.xxhash64(*df.columns), F.lit(100)) < int(share * 100)
        return df.where(~test), df.where(test)
    cut = months[min(len(months) - 1, int(len(months) * (1 - share)))]
    return df.where(F.col(month) < cut), df.where(F.col(month) >= cut)


def fit_risk(train: DataFrame, columns: Sequence[str], label: str, seed: int = 42):
    """A balanced random forest of 100 trees of depth 10."""
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, total / (len(n) * v))))[F.col(label)]
    stages = [VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip"), RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__w", numTrees=100, maxDepth=10, seed=seed)]
    return Pipeline(stages=stages).fit(train.withColumn("__w", weight))


def score_risk(df: DataFrame, model) -> DataFrame:
    """Probability of a high return rate and its level."""
    p = model.transform(df).withColumn("probabilidad", vector_to_array("probability")[1])
    return p.withColumn("riesgo", F.when(F.col("probabilidad") >= 0.7, "ALTO").when(F.col("probabilidad") >= 0.4, "MEDIO").otherwise("BAJO"))


def auc(scored: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction").evaluate(scored)


def jaccard(left: DataFrame, right: DataFrame, key: str) -> float:
    """Of two sets of keys."""
    both = left.select(key).distinct().withColumn("a", F.lit(1)).join(right.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    r = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("i"), F.count("*").alias("u")).first()
    return r["i"] / r["u"] if r["u"] else 1.0


def bootstrap_stability(df: DataFrame, key: str, flag: Callable[[DataFrame], DataFrame], runs: int = 30, seed: int = 7) -> float:
    """Mean Jaccard similarity of the flagged keys of resamples with those of the whole table."""
    whole = flag(df).cache()
    found = [jaccard(whole.join(s := df.sample(True, 1.0, seed + k).dropDuplicates([key]), key, "left_semi"), flag(s), key) for k in range(runs)]
    return sum(found) / len(found)


def contamination_sweep(df: DataFrame, columns: Sequence[str], levels: Sequence[float] = (0.05, 0.1, 0.15, 0.2)) -> tuple[float, dict[float, float]]:
    """The contamination whose flagged rows score furthest above the others on the mean."""
    gaps = {}
    for c in levels:
        r = isolation_forest(df, columns, c).agg(F.avg(F.when(F.col("es_anomalia"), F.col("anomaly_score"))).alias("a"), F.avg(F.when(~F.col("es_anomalia"), F.col("anomaly_score"))).alias("b")).first()
        gaps[c] = abs((r["a"] or 0.0) - (r["b"] or 0.0))
    return max(gaps, key=lambda c: (gaps[c], -c)), gaps


def rule_score(confidence: float, stability: float, lift: float, seconds: float) -> float:
    """Benchmark score of a rule miner."""
    return 0.4 * confidence + 0.3 * stability + 0.2 * lift - 0.1 * seconds


def name_clusters(centres: DataFrame, volume: str, returns: str) -> DataFrame:
    """Alto/Bajo Vol and Alta/Baja Dev of cluster centres against the medians of the centres."""
    m = centres.agg(F.median(volume).alias("v"), F.median(returns).alias("r"))
    joined = centres.crossJoin(F.broadcast(m))  # one row of medians
    label = F.concat(F.when(F.col(volume) >= F.col("v"), "Alto Vol").otherwise("Bajo Vol"), F.lit(" / "), F.when(F.col(returns) >= F.col("r"), "Alta Dev").otherwise("Baja Dev"))
    return joined.withColumn("nombre", label).drop("v", "r")
