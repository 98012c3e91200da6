"""One-class support vector machine: the boundary around most rows, with a Gaussian kernel by random Fourier features.

The kernel exp(-gamma |x - y|^2) is the mean of cosines of random projections, so the machine is linear in ``width``
of them: w and rho minimise |w|^2 / 2 - rho + the mean of max(0, rho - w z) / nu. The corner of the hinge is rounded (a softened
maximum, sharper step by step), which makes the objective smooth, and Newton's method needs a few passes. A pass is one
aggregate: every task adds up gradient and curvature of its rows, the driver gets their sums, some width^2 / 2 numbers.

Missing and infinite values count as 0. With fewer than two rows, or without any spread, all scores are 0 and no row is an anomaly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siembra.operators.order_statistics import quantiles
from siembra.sources.scratch import written

#: Softness of the hinge's corner from step to step; step lengths that a pass compares.
SOFTNESS = (0.3, 0.1, 0.03, 0.01)
LENGTHS = 0.5 ** np.arange(12)


@dataclass
class OneClass:
    """Means and deviations of the columns, frequencies and phases of the features, weights and the boundary rho."""

    mean: np.ndarray
    spread: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    rho: float

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = (x - self.mean) / np.where(self.spread > 0, self.spread, 1.0)
        return np.sqrt(2.0 / len(self.phase)) * np.cos(scaled @ self.frequency.T + self.phase)

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight - self.rho


def _vector(columns: Sequence[str]):
    known = lambda c: F.col(c).cast("double")
    return F.array(*(F.when(F.abs(known(c)) < float("inf"), known(c)).otherwise(F.lit(0.0)) for c in columns))


def _soft(u: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """The softened max(0, -u) and its slope in -u."""
    v = -u / tau
    p = 1.0 / (1.0 + np.exp(-np.clip(v, -500, 500)))
    return tau * np.logaddexp(0.0, v), p


def _added(rows: DataFrame, width: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``add`` makes of a block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), float).reshape(-1, width)
            for a in range(0, len(x), 4096):
                part = add(x[a : a + 4096])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    sums = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(sums))
    for k, v in sums:
        out[k] = v
    return out


def fit(df: DataFrame, columns: Sequence[str], nu: float = 0.1, width: int = 64, gamma: float | None = None, seed: int = 42, steps: int = 8) -> OneClass:
    """The machine that leaves about a share of ``nu`` of the rows outside; ``gamma`` is 1 / columns unless given."""
    if not 0 < nu <= 1:
        raise ValueError("nu has to be in (0, 1]")
    d = len(columns)
    rows = written(df.select(_vector(columns).alias("x")), "one-class")
    moments = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[k]) for k in range(d) for f in (F.avg, F.stddev_pop))).first()
    n = moments[0]
    rng = np.random.default_rng(seed)
    # spread of rows that are all equal is rounding, not spread
    mean, spread = np.array([m or 0.0 for m in moments[1::2]]), np.array([s or 0.0 for s in moments[2::2]])
    spread = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean)), spread, 0.0)
    gamma = 1.0 / d if gamma is None else gamma
    model = OneClass(mean, spread, rng.normal(0, np.sqrt(2 * gamma), (width, d)), rng.uniform(0, 2 * np.pi, width), np.zeros(width), 0.0)
    if n < 2 or not spread.any():
        return model
    at, upper = np.zeros(width + 1), np.triu_indices(width + 1)
    ridge = np.r_[np.ones(width), 1e-9]
    wide = lambda x: np.c_[model.features(x), -np.ones(len(x))]
    for tau in SOFTNESS:
        for _ in range(steps):

            def slopes(x, at=at, tau=tau):
                z = wide(x)
                _, p = _soft(z @ at, tau)
                return np.r_[p @ z, ((z * (p * (1 - p) / tau)[:, None]).T @ z)[upper]]

            sums = _added(rows, d, slopes) / (nu * n)
            gradient = np.r_[at[:-1], -1.0] - sums[: width + 1]
            if np.abs(gradient).max() < 1e-7:
                break
            curvature = np.zeros((width + 1, width + 1))
            curvature[upper] = sums[width + 1 :]
            curvature = curvature + np.triu(curvature, 1).T + np.diag(ridge)
            move = -np.linalg.solve(curvature, gradient)

            def losses(x, at=at, move=move, tau=tau):
                z = wide(x)
                return np.array([_soft(z @ (at + t * move), tau)[0].sum() for t in (0.0, *LENGTHS)])

            tried = [at + t * move for t in (0.0, *LENGTHS)]
            objective = _added(rows, d, losses) / (nu * n) + np.array([a[:-1] @ a[:-1] / 2 - a[-1] for a in tried])
            best = int(objective.argmin())
            at = tried[best]
            if objective[0] - objective[best] < 1e-10:
                break
    model.weight, model.rho = at[:-1], float(at[-1])
    return model


def scored(df: DataFrame, model: OneClass, columns: Sequence[str], contamination: float = 0.1) -> DataFrame:
    """``df`` with ``score`` (the higher, the further outside) and ``es_anomalia``: above the exact quantile of 1 - contamination."""
    width = len(columns)

    @F.pandas_udf("double")
    def outside(x):
        import pandas as pd

        return pd.Series(np.round(-model.decision(np.array(x.tolist(), float).reshape(-1, width)), 12))

    out = df.withColumn("score", outside(_vector(columns)) if model.weight.any() else F.lit(0.0))
    limit = quantiles(out, "score", [1 - contamination]).select(F.col("q")[0].alias("q")).scalar()
    return out.withColumn("es_anomalia", F.col("score") > limit)
