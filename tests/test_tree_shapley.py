"""Shapley values against their definition over all sets of columns, and their sum against the prediction."""

from __future__ import annotations

from datetime import date
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from siembra.operators import extra_trees as XT
from siembra.operators import tree_shapley as TS

COLUMNS = ["a", "b", "c", "d"]


def tree_mean(tree, x, known, node=0):
    """A tree's mean when only ``known`` columns are."""
    column, threshold, left, right, cover, value = tree
    c = column[node]
    if c < 0:
        return value[node]
    if c in known:
        return tree_mean(tree, x, known, left[node] if x[c] <= threshold[node] else right[node])
    return sum(cover[k] / cover[node] * tree_mean(tree, x, known, k) for k in (left[node], right[node]))


def by_definition(tree, x):
    n, out = len(x), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(factorial(k) * factorial(n - 1 - k) / factorial(n) * (tree_mean(tree, x, {*s, i}) - tree_mean(tree, x, set(s))) for k in range(n) for s in combinations(rest, k)))
    return out


def random_tree(rng, columns, depth):
    tree = [[], [], [], [], [], []]

    def grow(level, cover):
        node = len(tree[0])
        for part, x in zip(tree, (-1, 0.0, -1, -1, cover, rng.normal()), strict=True):
            part.append(x)
        if level < depth and cover > 1 and rng.random() < 0.9:
            tree[0][node], tree[1][node] = int(rng.integers(columns)), float(rng.integers(-2, 3))
            cut = int(rng.integers(1, cover))
            tree[2][node] = grow(level + 1, cut)
            tree[3][node] = grow(level + 1, cover - cut)
        return node

    grow(0, 200)
    return tree


@pytest.mark.parametrize("seed", range(8))
def test_values_are_those_of_the_definition(seed):
    rng = np.random.default_rng(seed)
    trees = [random_tree(rng, 5, depth) for depth in (0, 1, 3, 6)]
    x = rng.integers(-3, 4, (25, 5)).astype(float)
    made = [TS.paths(*t) for t in trees]
    for t, p in zip(trees, made, strict=True):
        assert np.allclose(TS.values(x, [p]), [by_definition(t, row) for row in x])
        assert np.isclose(p.base, tree_mean(t, x[0], set()))
    assert np.allclose(TS.values(x, made, cells=64), TS.values(x, made))


def data(spark):
    i = F.col("id")
    cols = {"a": i % 13, "b": i * 7 % 11, "c": i * i % 17, "d": F.lit(1)}
    df = spark.range(400).select(*(c.cast("double").alias(n) for n, c in cols.items()), F.concat(F.lit("p"), (i % 30).cast("string")).alias("product_id"), F.lit(date(2024, 1, 1)).alias("periodo"))
    return df.withColumn("target_qty", F.col("a") * 2 - F.col("b") + F.col("a") * (F.col("c") > 8).cast("double") * 3)


@pytest.mark.parametrize("kind, settings", [(RandomForestRegressor, {"numTrees": 4, "maxDepth": 6}), (GBTRegressor, {"maxIter": 4, "maxDepth": 4})])
def test_contributions_add_up_to_the_prediction(spark, kind, settings):
    x = VectorAssembler(inputCols=COLUMNS, outputCol="x").transform(data(spark))
    model = kind(featuresCol="x", labelCol="target_qty", predictionCol="p", seed=3, **settings).fit(x)
    out = TS.explained(model.transform(x), TS.of_model(model), COLUMNS).select("p", "shap", "shap_base").toPandas()
    sums = np.array(out["shap"].tolist())
    assert np.allclose(sums.sum(1) + out["shap_base"], out["p"])
    assert (sums[:, 3] == 0).all()


def test_randomised_trees_tables_and_empty_input(spark):
    df = data(spark)
    forest = XT.fit(df, COLUMNS, F.col("target_qty"), [date(2024, 1, 1)], trees=3, depth=5)
    scored = TS.explained(XT.predict(df, forest, COLUMNS, 0), TS.of_forest(forest, 0), COLUMNS)
    out = scored.toPandas()
    assert np.allclose([sum(s) + b for s, b in zip(out["shap"], out["shap_base"], strict=True)], out["raw"])
    table = {r.feature: r for r in TS.importance(scored, COLUMNS).collect()}
    sums = np.array(out["shap"].tolist())
    for k, c in enumerate(COLUMNS):
        assert np.isclose(table[c].mean_abs_shap, np.abs(sums[:, k]).mean()) and np.isclose(table[c].mean_shap, sums[:, k].mean())
    assert [r.feature for r in sorted(table.values(), key=lambda r: r.rank)] == sorted(COLUMNS, key=lambda c: -table[c].mean_abs_shap)
    top = TS.product_importance(scored, COLUMNS, products=3, features=2).collect()
    totals = out.groupby("product_id")["target_qty"].sum().sort_values(ascending=False)
    assert {r.product_id for r in top} == set(totals.index[:3]) and len(top) == 6
    for r in top:
        own = sums[(out["product_id"] == r.product_id).to_numpy()][:, COLUMNS.index(r.feature)]
        assert np.isclose(r.mean_abs_shap, np.abs(own).mean()) and r.direction == ("incrementa" if own.mean() >= 0 else "reduce")
    none = TS.explained(df.limit(0), TS.of_forest(forest, 0), COLUMNS)
    assert TS.importance(none, COLUMNS).count() == TS.product_importance(none, COLUMNS).count() == 0
    gaps = TS.explained(df.limit(1).withColumn("a", F.lit(None).cast("double")), TS.of_forest(forest, 0), COLUMNS).first()
    assert np.isfinite(gaps["shap"]).all()
