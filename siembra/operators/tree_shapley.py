"""Shapley values of tree ensembles: what each column adds to a row's prediction.

The value of a set of columns is the tree's mean when only they are known: at a split on another column
a row goes both ways, in the proportions of the training rows. A leaf is then a product over the columns on
its path, of 1 or 0 (the row fits the path's interval of that column) for a known one and of the share of rows that
pass its splits for an unknown one. The weight of a set of k out of d columns is the integral of t^k (1 - t)^(d - 1 - k) over
0 to 1, so a column's value is an integral of a polynomial of degree d - 1, which Gauss-Legendre points give exactly. All rows
of a chunk, leaves of a tree and columns of a path are one array; nothing is enumerated or sampled.

The nodes (at most 2^(depth + 1) a tree) are sent to the tasks; rows stay in their partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siembra.operators.extra_trees import Forest
from siembra.sources.scratch import dropped, shared_folder


@dataclass
class Paths:
    """The leaves of one tree: columns on the path (0 where there are fewer), their intervals (low, high], shares, the leaf's value."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @property
    def base(self) -> float:
        return float((self.value * self.share.prod(1)).sum())


def paths(column: Sequence[int], threshold: Sequence[float], left: Sequence[int], right: Sequence[int], cover: Sequence[float], value: Sequence[float], weight: float = 1.0) -> Paths:
    """Paths of a tree whose root is node 0; a node with a negative column is a leaf, rows up to the threshold go left."""
    leaves, todo = [], [(0, {})]
    while todo:
        node, known = todo.pop()
        c = column[node]
        if c < 0:
            leaves.append((known, value[node] * weight))
            continue
        low, high, share = known.get(c, (-np.inf, np.inf, 1.0))
        for child, span in ((left[node], (low, min(high, threshold[node]))), (right[node], (max(low, threshold[node]), high))):
            todo.append((child, {**known, c: (*span, share * (cover[child] / cover[node] if cover[node] else 0.0))}))
    width = max(1, max(len(known) for known, _ in leaves))
    out = Paths(np.zeros((len(leaves), width), np.int64), np.full((len(leaves), width), -np.inf), np.full((len(leaves), width), np.inf), np.ones((len(leaves), width)), np.array([v for _, v in leaves]))
    for i, (known, _) in enumerate(leaves):
        for j, (c, (low, high, share)) in enumerate(sorted(known.items())):
            out.column[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = c, low, high, share
    return out


def values(x: np.ndarray, trees: Sequence[Paths], cells: int = 1 << 19) -> np.ndarray:
    """Shapley values of the rows of ``x``, by column; ``cells`` bounds the arrays of a chunk of rows."""
    out = np.zeros(x.shape)
    for p in trees:
        n, d = p.column.shape
        places, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        places, weights = (places + 1) / 2, weights / 2
        to_column = np.zeros((n * d, x.shape[1]))
        to_column[np.arange(n * d), p.column.ravel()] = 1.0
        step = max(1, cells // (n * d))
        for a in range(0, len(x), step):
            at = x[a : a + step][:, p.column]
            fits = ((at > p.low) & (at <= p.high)).astype(float)
            total = np.zeros_like(fits)
            for t, w in zip(places, weights, strict=True):
                term = p.share * (1 - t) + fits * t
                before, after = np.ones_like(term), np.ones_like(term)
                before[..., 1:] = np.cumprod(term[..., :-1], -1)
                after[..., :-1] = np.cumprod(term[..., :0:-1], -1)[..., ::-1]
                total += w * before * after
            out[a : a + step] += ((fits - p.share) * total * p.value[:, None]).reshape(len(at), -1) @ to_column
    return out


def of_model(model: RandomForestRegressionModel | GBTRegressionModel) -> list[Paths]:
    """Paths of a fitted ensemble's trees, weighted as in its prediction. Splits by category are refused."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    stored._written = path
    nodes = stored.select("treeID", "nodeData.*").select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("impurityStats")[0].alias("cover"), "split.featureIndex", "split.numCategories", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    trees: dict[int, list] = {}
    for r in nodes.orderBy("treeID", "id").collect():
        if r["numCategories"] >= 0:
            raise ValueError("trees with categorical splits can't be explained")
        trees.setdefault(r["treeID"], []).append(r)
    dropped(stored)
    whole = len(trees) if isinstance(model, RandomForestRegressionModel) else 1
    pick = lambda rows, c: [r[c] for r in rows]
    return [paths(pick(rows, "featureIndex"), [t or 0.0 for t in pick(rows, "threshold")], pick(rows, "leftChild"), pick(rows, "rightChild"), pick(rows, "cover"), pick(rows, "prediction"), model.treeWeights[k] / whole) for k, rows in sorted(trees.items())]


def of_forest(forest: Forest, window: int) -> list[Paths]:
    """Paths of the extremely randomised trees of one training window."""
    own = [t for t, w in enumerate(forest.windows) if w == window]
    return [paths(forest.feature[t], forest.threshold[t], forest.left[t], [k + 1 for k in forest.left[t]], forest.cover[t], forest.mean[t], 1 / len(own)) for t in own]


def explained(df: DataFrame, trees: Sequence[Paths], columns: Sequence[str], name: str = "shap") -> DataFrame:
    """``df`` with the array of its columns' values and ``<name>_base``, the prediction when nothing is known. Missing values count as 0."""
    width = len(columns)

    @F.pandas_udf("array<double>")
    def run(x):
        import pandas as pd

        return pd.Series(list(values(np.array(x.tolist(), float).reshape(-1, width), trees)), dtype=object)

    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return df.withColumns({name: run(x), f"{name}_base": F.lit(sum(t.base for t in trees))})


def _sorted(columns: Sequence[str], name: str) -> tuple[list[Column], Column]:
    """Means by column as aggregates, and the columns in falling order of mean size (equal ones by name) made of them."""
    means = [c for k, _ in enumerate(columns) for c in (F.avg(F.abs(F.col(name)[k])).alias(f"__a{k}"), F.avg(F.col(name)[k]).alias(f"__m{k}"))]
    each = [F.struct((-F.round(f"__a{k}", 9)).alias("o"), F.lit(c).alias("feature"), F.col(f"__a{k}").alias("mean_abs_shap"), F.col(f"__m{k}").alias("mean_shap")) for k, c in enumerate(columns)]
    return means, F.array_sort(F.array(*each))


def importance(rows: DataFrame, columns: Sequence[str], name: str = "shap") -> DataFrame:
    """Mean size and mean of every column's value over all rows, with its rank. No rows give none."""
    means, order = _sorted(columns, name)
    out = rows.agg(F.count("*").alias("__n"), *means).where("__n > 0").select(F.posexplode(order).alias("k", "s"))
    return out.select((F.col("k") + 1).alias("rank"), "s.feature", "s.mean_abs_shap", "s.mean_shap")


def product_importance(rows: DataFrame, columns: Sequence[str], key: str = "product_id", target: str = "target_qty", products: int = 20, features: int = 5, name: str = "shap") -> DataFrame:
    """The strongest columns of the products of most volume, and whether they raise or lower the prediction. Ties go by key and by name."""
    means, order = _sorted(columns, name)
    total = F.sum(F.coalesce(F.col(target), F.lit(0.0)).cast("decimal(18,4)")).cast("double")
    top = rows.groupBy(key).agg(total.alias("target_qty_total"), *means).orderBy(F.desc("target_qty_total"), key).limit(products)
    out = top.select(key, "target_qty_total", F.posexplode(F.slice(order, 1, features)).alias("k", "s"))
    return out.select(key, "target_qty_total", (F.col("k") + 1).alias("rank"), "s.feature", "s.mean_abs_shap", "s.mean_shap", F.when(F.col("s.mean_shap") >= 0, "incrementa").otherwise("reduce").alias("direction"))
