"""Linear models of many training windows from one pass: sums of products by month are added up, rows aren't read again.

The sums X'X, X'y and y'y of a month merge by addition. Those of all months up to a cut are a prefix sum, so the
linear and the ridge model of every window follow from one table of as many rows as there are
months. Values are taken about the means of all rows, which keeps the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Sums of (1, x - shift, y - shift of y) times itself, over some rows."""

    columns: tuple[str, ...]
    shift: np.ndarray
    sums: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.shift, self.sums + other.sums)

    @property
    def rows(self) -> int:
        return round(self.sums[0, 0])

    def solve(self, penalty: float = 0.0) -> tuple[float, np.ndarray]:
        """(intercept, slopes) of the least squares fit; the penalty is on slopes of standardised columns.

        Columns without spread have slope 0; of dependent ones the shortest solution is taken.
        """
        n = self.sums[0, 0]
        if n < 1:
            raise ValueError("no rows to fit")
        mean = self.sums[0, 1:] / n
        spread = self.sums[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(spread)[:-1], 0))
        level = np.maximum(np.abs(self.shift[:-1]), 1.0) * 1e-9
        known = scale > level
        unit = np.where(known, scale, 1.0)
        gram = spread[:-1, :-1] / np.outer(unit, unit)
        gram[~known], gram[:, ~known] = 0.0, 0.0
        target = np.where(known, spread[:-1, -1] / unit, 0.0)
        slopes = np.linalg.lstsq(gram + np.eye(len(gram)) * (penalty / n), target, rcond=1e-9)[0] / unit
        at = self.shift + mean
        return float(at[-1] - slopes @ at[:-1]), slopes


def monthly_moments(df: DataFrame, columns: Sequence[str], target: Column, month: str = "periodo") -> dict[date, Moments]:
    """The moments of each month. The result is (columns + 2) squared numbers a month, whatever the rows."""
    rows = df.select(F.col(month).alias("month"), F.array(*(F.col(c).cast("double") for c in columns), target.cast("double")).alias("z")).where("month IS NOT NULL")
    means = rows.agg(*(F.avg(F.col("z")[k]).alias(f"m{k}") for k in range(len(columns) + 1))).first()
    shift = np.array([m or 0.0 for m in means])
    wide = len(columns) + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.ones((batch.num_rows, wide))
            z[:, 1:] = np.asarray(batch.column("z").flatten()).reshape(-1, wide - 1) - shift
            months = batch.column("month")
            for m in pc.unique(months):
                part = z[np.asarray(pc.equal(months, m))]
                total[m.as_py()] = total.get(m.as_py(), 0.0) + part.T @ part
        for m, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * wide * wide, pa.date32()), pa.array(np.arange(wide * wide, dtype=np.int32)), pa.array(t.ravel())], names=["month", "at", "value"])

    merged = rows.mapInArrow(sums, "month date, at int, value double").groupBy("month", "at").agg(F.sum("value").alias("value"))
    out: dict[date, Moments] = {}
    for m, at, value in merged.collect():
        found = out.setdefault(m, Moments(tuple(columns), shift, np.zeros((wide, wide))))
        found.sums[at // wide, at % wide] = value
    return dict(sorted(out.items()))


def until(moments: dict[date, Moments], last: date) -> Moments | None:
    """The moments of all months up to ``last``."""
    total = None
    for m, x in moments.items():
        if m <= last:
            total = x if total is None else total + x
    return total


def fitted(intercept: Column, slopes: Column, columns: Sequence[str]) -> Column:
    """The model's value for a row, from an array of slopes in the order of ``columns``."""
    return intercept + sum((F.col(c).cast("double") * slopes[k] for k, c in enumerate(columns)), F.lit(0.0))
