from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from siembra.operators import extra_trees as ET

COLUMNS = ["a", "b", "c"]


def rows(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(0, 9, n), rng.normal(0, 2, n).round(3), np.full(n, 4)]
    y = 3 * (x[:, 0] > 4) + x[:, 1] + rng.normal(0, 0.1, n)
    return [(float(p), float(q), float(r), float(t), date(2020, 1 + k % 12, 1)) for k, ((p, q, r), t) in enumerate(zip(x, y, strict=True))]


def grown(x, y, seed, tree, depth, leaf, path=1):
    """One tree by recursion over the rows themselves; (feature, threshold, left, right) or the mean."""
    spread = x.max(0) > x.min(0)
    if depth == 0 or len(y) < 2 * leaf or not spread.any():
        return y.mean()
    t = x.min(0) + ET.draw(seed, tree, path, x.shape[1]) * (x.max(0) - x.min(0))
    best = None
    for f in range(x.shape[1]):
        low = x[:, f] <= t[f]
        if low.sum() >= leaf and (~low).sum() >= leaf:
            error = sum(((y[m] - y[m].mean()) ** 2).sum() for m in (low, ~low))
            if best is None or error < best[0] - 1e-9:
                best = (error, f, low)
    if best is None or not spread[best[1]]:
        return y.mean()
    _, f, low = best
    return f, t[f], grown(x[low], y[low], seed, tree, depth - 1, leaf, 2 * path), grown(x[~low], y[~low], seed, tree, depth - 1, leaf, 2 * path + 1)


def value(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


@pytest.mark.parametrize(("depth", "leaf"), [(1, 3), (4, 3), (3, 20)])
def test_trees_equal_recursion(spark, depth, leaf):
    data = rows()
    df = spark.createDataFrame(data, "a double, b double, c double, y double, periodo date").repartition(5)
    cuts = [date(2020, 6, 1), date(2020, 12, 1)]
    forest = ET.fit(df, COLUMNS, F.col("y"), cuts, trees=3, depth=depth, least_leaf=leaf, seed=7)
    assert len(forest.feature) == 6
    for window, cut in enumerate(cuts):
        past = np.array([r[:4] for r in data if r[4] <= cut])
        trees = [grown(past[:, :3], past[:, 3], 7, 3 * window + k, depth, leaf) for k in range(3)]
        got = {(r["a"], r["b"], r["y"]): r["raw"] for r in ET.predict(df, forest, COLUMNS, window).collect()}
        assert all(got[a, b, y] == pytest.approx(np.mean([value(t, (a, b, c)) for t in trees])) for a, b, c, y, _ in data)


def test_it_learns_and_hard_rows(spark):
    data = rows(400)
    df = spark.createDataFrame([*data, (None, 1.0, None, 2.0, date(2020, 1, 1)), (1.0, 1.0, 1.0, None, date(2020, 1, 1)), (1.0, 1.0, 1.0, 1.0, None)], "a double, b double, c double, y double, periodo date")
    forest = ET.fit(df, COLUMNS, F.col("y"), [date(2021, 1, 1)], trees=10, depth=7)
    got = ET.predict(df.where("y IS NOT NULL"), forest, COLUMNS, 0).select("y", "raw").collect()
    y, p = np.array([r["y"] for r in got]), np.array([r["raw"] for r in got])
    assert ((y - p) ** 2).mean() < 0.15 * y.var()


def test_no_rows_is_a_tree_of_one_leaf(spark):
    df = spark.createDataFrame([], "a double, b double, c double, y double, periodo date")
    forest = ET.fit(df, COLUMNS, F.col("y"), [date(2020, 1, 1)], trees=2)
    assert forest.feature == [[-1], [-1]] and forest.mean == [[0.0], [0.0]]
