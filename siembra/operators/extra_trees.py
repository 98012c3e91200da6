"""Extremely randomised regression trees, grown level by level for all trees and training windows at once.

Each node draws one threshold per feature, uniform between the least and the largest value of its rows, and
splits by the feature whose threshold leaves the smallest squared error. A level takes two aggregates
by (node, feature) over the rows: the ranges and totals, then the sums on the left of every threshold.
Rows stay where they are; a task finds the nodes of its rows from the trees grown so far and combines
its rows before anything is shuffled. The driver holds the trees alone: at most 2^(depth + 1) nodes a tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Forest:
    """Trees as tables of nodes: split feature (-1 for a leaf), threshold, place of the left child (the right one follows), mean, rows."""

    windows: list[int]
    feature: list[list[int]] = field(default_factory=list)
    threshold: list[list[float]] = field(default_factory=list)
    left: list[list[int]] = field(default_factory=list)
    mean: list[list[float]] = field(default_factory=list)
    path: list[list[int]] = field(default_factory=list)
    cover: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.feature:
            n = len(self.windows)
            self.feature, self.threshold, self.left, self.mean, self.path, self.cover = ([[x] for _ in range(n)] for x in (-1, 0.0, 0, 0.0, 1, 0.0))

    def packed(self) -> tuple[np.ndarray, ...]:
        wide = max(len(t) for t in self.feature)
        return tuple(np.array([[*t, *[0] * (wide - len(t))] for t in table]) for table in (self.feature, self.threshold, self.left, self.mean))


def _places(x: np.ndarray, tree: int, packed: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """The node of each row in a tree."""
    feature, threshold, left, _ = packed
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = feature[tree, at]
        right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[tree, at]
        at = np.where(f >= 0, left[tree, at] + right, at)
    return at


def draw(seed: int, tree: int, path: int, features: int) -> np.ndarray:
    """The place of each feature's threshold in its range; ``path`` is 1 at the root, 2p and 2p + 1 below p."""
    return np.random.default_rng([seed, tree, path]).random(features)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), float).reshape(-1, width)


def _by_node(rows: DataFrame, forest: Forest, open_nodes: dict[tuple[int, int], int], width: int, depth: int, cuts: list[date], thresholds: np.ndarray | None) -> DataFrame:
    """Sums of a task's rows by (open node, feature): ranges and totals, or the sums on either side of the thresholds."""
    packed = forest.packed()
    slot_of = np.full(packed[0].shape, -1, np.int64)
    for (tree, node), slot in open_nodes.items():
        slot_of[tree, node] = slot
    windows = forest.windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_nodes), width, 4))
        total[:, :, 2:] = (np.inf, -np.inf) if thresholds is None else 0.0
        for batch in batches:
            x, y, month = _matrix(batch, width), np.asarray(batch.column("y")), np.asarray(batch.column("month"))
            for tree, window in enumerate(windows):
                slot = slot_of[tree, _places(x, tree, packed, depth)]
                kept = np.flatnonzero((slot >= 0) & (month <= np.datetime64(cuts[window])))
                if not len(kept):
                    continue
                kept = kept[np.argsort(slot[kept], kind="stable")]
                s, v, t = slot[kept], x[kept], y[kept]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                nodes = s[starts]
                if thresholds is None:
                    total[nodes, :, 0] += np.add.reduceat(np.ones_like(t), starts)[:, None]
                    total[nodes, :, 1] += np.add.reduceat(t, starts)[:, None]
                    total[nodes, :, 2] = np.minimum(total[nodes, :, 2], np.minimum.reduceat(v, starts))
                    total[nodes, :, 3] = np.maximum(total[nodes, :, 3], np.maximum.reduceat(v, starts))
                else:
                    low = v <= thresholds[s]
                    for k, z in enumerate((low, low * t[:, None], ~low, ~low * t[:, None])):
                        total[nodes, :, k] += np.add.reduceat(z.astype(float), starts)
        seen = np.flatnonzero((total[:, 0, 0] + (total[:, 0, 2] if thresholds is not None else 0)) > 0)
        slots, features = np.repeat(seen, width), np.tile(np.arange(width), len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(features.astype(np.int32)), *(pa.array(total[seen, :, k].ravel()) for k in range(4))], names=["slot", "f", "a", "b", "c", "d"])

    return rows.mapInArrow(run, "slot int, f int, a double, b double, c double, d double")


def fit(df: DataFrame, columns: Sequence[str], target: Column, cuts: Sequence[date], trees: int = 40, depth: int = 8, least_leaf: int = 3, seed: int = 42, month: str = "periodo") -> Forest:
    """``trees`` trees for each cut, from the rows of months up to it. Missing values count as 0.

    ``df`` should be a written table: it is read twice a level. Nodes of less than twice ``least_leaf`` rows,
    without spread, or at ``depth`` are leaves; a split leaves ``least_leaf`` rows on either side.
    """
    width, cuts = len(columns), list(cuts)
    rows = df.select(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("x"), target.cast("double").alias("y"), F.col(month).cast("date").alias("month")).where("y IS NOT NULL AND month IS NOT NULL")
    forest = Forest([k for k in range(len(cuts)) for _ in range(trees)])
    frontier = [(t, 0) for t in range(len(forest.windows))]
    for level in range(depth + 1):
        if not frontier:
            break
        slots = {node: k for k, node in enumerate(frontier)}
        ranges = _by_node(rows, forest, slots, width, level, cuts, None).groupBy("slot", "f").agg(F.sum("a"), F.sum("b"), F.min("c"), F.max("d")).collect()
        low, high = np.zeros((len(frontier), width)), np.zeros((len(frontier), width))
        count = np.zeros(len(frontier))
        for slot, f, n, s, a, b in ranges:
            low[slot, f], high[slot, f], count[slot] = a, b, n
            tree, node = frontier[slot]
            forest.mean[tree][node], forest.cover[tree][node] = s / n, float(n)
        if level == depth:
            break
        place = np.array([draw(seed, t, forest.path[t][node], width) for t, node in frontier])
        thresholds = low + place * (high - low)
        grows = (count >= 2 * least_leaf) & (high > low).any(1)
        frontier, thresholds, spread = [n for n, g in zip(frontier, grows, strict=True) if g], thresholds[grows], (high > low)[grows]
        if not frontier:
            break
        slots = {node: k for k, node in enumerate(frontier)}
        sums = _by_node(rows, forest, slots, width, level, cuts, thresholds).groupBy("slot", "f").agg(*(F.sum(c).alias(c) for c in "abcd")).where((F.col("a") >= least_leaf) & (F.col("c") >= least_leaf))
        # the squared error is smallest where the squares of both sides' sums by their counts are largest
        score = F.col("b") * F.col("b") / F.col("a") + F.col("d") * F.col("d") / F.col("c")
        best = sums.groupBy("slot").agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("f")).alias("f"))).alias("best"))
        after = []
        for slot, (_, minus) in best.collect():
            f, (tree, node) = -minus, frontier[slot]
            if spread[slot, f]:
                child = len(forest.feature[tree])
                forest.feature[tree][node], forest.threshold[tree][node], forest.left[tree][node] = f, float(thresholds[slot, f]), child
                for k in (0, 1):
                    forest.feature[tree].append(-1)
                    forest.threshold[tree].append(0.0)
                    forest.left[tree].append(0)
                    forest.mean[tree].append(0.0)
                    forest.cover[tree].append(0.0)
                    forest.path[tree].append(2 * forest.path[tree][node] + k)
                after += [(tree, child), (tree, child + 1)]
        frontier = sorted(after)
    return forest


def predict(df: DataFrame, forest: Forest, columns: Sequence[str], window: int, name: str = "raw", depth: int = 64) -> DataFrame:
    """``df`` with the mean over the window's trees in a column ``name``."""
    packed, width = forest.packed(), len(columns)
    own = [t for t, w in enumerate(forest.windows) if w == window]
    deepest = min(depth, max(p.bit_length() for t in own for p in forest.path[t]))

    @F.pandas_udf("double")
    def mean(x):
        import pandas as pd

        values = np.array(x.tolist(), float).reshape(-1, width)
        return pd.Series(np.mean([packed[3][t, _places(values, t, packed, deepest)] for t in own], axis=0))

    return df.withColumn(name, mean(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))))
