"""The features of ``forecast.prepared`` over ``panel.complete_grid``, made for many products at once: a row a product, a column a month.

A product's months go to Python as one list of what was observed, and grids, lags, rolling values and the
point-in-time profile are array operations over products. What they mean is said there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siembra.operators.panel import LAGS, ROLLS

#: Months of products that are held at once.
CELLS = 1 << 17
INACTIVE_MONTHS, TOP_SHARE, MOST_ACTIVE_MONTHS = 12, 0.6, 4


def _back(a: np.ndarray, k: int, none: float = 0.0) -> np.ndarray:
    """Every row moved ``k`` months later."""
    out = np.full_like(a, none)
    out[:, k:] = a[:, :-k] if k < a.shape[1] else a[:, :0]
    return out


def matrix(q: np.ndarray, start: np.ndarray, first: int) -> dict[str, np.ndarray]:
    """Features of each product's months: ``q`` (products by months, 0 before ``start``), ``first`` is the first column's year * 12 + month - 1."""
    wide = q.shape[1]
    month = first + np.arange(wide)
    before = np.arange(wide) - start[:, None]
    inside = before >= 0
    active = (q > 0) & inside
    out = {f"lag_{k}": _back(q, k) for k in LAGS}
    total, most, seen, on = np.zeros_like(q), np.full_like(q, -np.inf), np.where(inside, q, -np.inf), np.zeros_like(q)
    share = lambda a, n: np.divide(a, n, out=np.zeros_like(q), where=n > 0)
    for k in range(1, 13):
        total += _back(q, k)
        on += _back(active.astype(float), k)
        most = np.maximum(most, _back(seen, k, -np.inf))
        if k in ROLLS:
            out[f"rolling_mean_{k}"] = share(total, np.minimum(before, k))
        if k in (6, 12):
            out[f"nonzero_{k}"] = on.copy()
    out["rolling_max_12"] = np.where(before > 0, most, 0.0)
    out["expanding_mean"] = share(_back(np.cumsum(q, 1), 1), before)
    out["expanding_max"] = np.where(before > 0, _back(np.maximum.accumulate(seen, 1), 1, -np.inf), 0.0)
    out["months_since_first"] = before.astype(float)
    turn = (month % 12 + 1) * (2 * math.pi / 12)
    for name, value in {"month": month % 12 + 1, "quarter": month % 12 // 3 + 1, "year": month // 12, "month_sin": np.sin(turn), "month_cos": np.cos(turn)}.items():
        out[name] = np.broadcast_to(value.astype(float), q.shape)
    by_month, by_year, last = np.zeros((len(q), 12)), np.zeros((len(q), wide // 12 + 2), np.int64), np.full(len(q), -1)
    top_share, flag, season, latest = np.zeros_like(q), np.zeros_like(q), np.zeros(q.shape, bool), np.full(q.shape, -1)
    rows = np.arange(len(q))
    for t in range(wide):
        top = np.argsort(-by_month, 1, kind="stable")[:, :3]
        sums = np.take_along_axis(by_month, top, 1)
        held = sums > 0
        all_months = by_month.cumsum(1)[:, -1]
        part = np.divide((sums * held).cumsum(1)[:, -1], all_months, out=np.zeros(len(q)), where=all_months > 0)
        n = (by_year > 0).sum(1)
        counts = np.sort(np.where(by_year > 0, by_year, wide + 13), 1)
        median = np.where(n > 0, (counts[rows, np.maximum((n + 1) // 2 - 1, 0)] + counts[rows, n // 2]) / 2, 0.0)
        season[:, t] = (n >= 2) & ((part >= TOP_SHARE) | (median <= MOST_ACTIVE_MONTHS))
        top_share[:, t], flag[:, t], latest[:, t] = np.round(part, 4), (held & (top == month[t] % 12)).any(1), last
        now = active[:, t]
        by_month[:, month[t] % 12] += np.where(now, q[:, t], 0.0)
        by_year[:, month[t] // 12 - first // 12] += now
        last[now] = t
    return out | {"share_top_3_meses": top_share, "seasonal_month_flag": flag, "es_estacional": season, "latest": latest, "inside": inside}


def modelled(panel: DataFrame, features: Sequence[str], key: str = "product_id", month: str = "periodo", qty: str = "target_qty") -> DataFrame:
    """(key, month, qty, estado_producto, es_estacional, ultima_actividad, features) of every month of the complete grid."""
    panel = panel.where(F.col(month).isNotNull())
    index = (F.year(month) * 12 + F.month(month) - 1).alias("m")
    ends = panel.agg(F.min(F.when(F.col(qty) > 0, F.year(month) * 12 + F.month(month) - 1)), F.max(F.year(month) * 12 + F.month(month) - 1)).first()
    kind = panel.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {month} date, {qty} double, estado_producto string, es_estacional boolean, ultima_actividad date, " + ", ".join(f"{c} double" for c in features)
    if ends[0] is None:
        return panel.sparkSession.createDataFrame([], schema)
    low, wide = ends[0], ends[1] - ends[0] + 1
    days = ((np.arange(low, low + wide) - 1970 * 12).astype("datetime64[M]").astype("datetime64[D]")).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // wide)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                seen = part.column("seen")
                row = np.repeat(np.arange(len(seen)), np.asarray(seen.value_lengths()))
                m, v = (np.asarray(c) for c in seen.flatten().flatten())
                q, known = np.zeros((len(seen), wide)), m >= low
                q[row[known], m[known] - low] = v[known]
                some = (q > 0).any(1)
                q, start, names = q[some], (q[some] > 0).argmax(1), part.column(key).filter(pa.array(some))
                q *= np.arange(wide) >= start[:, None]
                if not len(q):
                    continue
                out = matrix(q, start, low)
                i, t = np.nonzero(out["inside"])
                latest = out["latest"][i, t]
                date = lambda k, none=None: pa.array(days[np.maximum(k, 0)], pa.int32(), mask=none).cast(pa.date32())
                state = pa.array(["inactivo", "activo"]).take(pa.array(((latest >= 0) & (latest >= t - INACTIVE_MONTHS)).astype(np.int8)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), date(t), pa.array(q[i, t]), state, pa.array(out["es_estacional"][i, t]), date(latest, latest < 0), *(pa.array(out[c][i, t]) for c in features)], schema=wanted)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    # few bytes, much work: a stated number of partitions isn't merged by size
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = panel.select(key, index, F.coalesce(F.col(qty).cast("double"), F.lit(0.0)).alias("q")).repartition(parts, key)
    return dealt.groupBy(key).agg(F.collect_list(F.struct("m", "q")).alias("seen")).mapInArrow(run, schema)
