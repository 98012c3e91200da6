"""The best model of each segment, with back-off to the segment above where rows are few.

Segments are the nodes of a tree: all rows, then one column after another. Errors of every model are sums,
so they are added up once for the finest segments and rolled up from there; rows are read once,
whatever the number of levels and models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("train", "val", "test")
#: Least rows of a segment of its own in training, validation and test. Fixed values.
LEAST_ROWS = (60, 10, 10)


def _path(levels: Sequence[str], depth: int) -> Column:
    return F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels[:depth])).cast("array<string>")


def node_errors(rows: DataFrame, levels: Sequence[str], part: str, actual: str, models: Sequence[str]) -> DataFrame:
    """(path, n_train, n_val, n_test, errors): by segment the rows of each part and, for each model, its errors in the validation rows.

    ``models`` are columns of predictions; negative ones count as 0, missing ones as well. Rows without an actual
    value count nowhere. Errors are structs of (wape, bias, smape, modelo) that sort from best to worst.
    """
    y, in_val = F.col(actual).cast("double"), F.col(part) == "val"
    exact = lambda c: F.coalesce(F.sum(F.when(in_val, c.cast("decimal(24,6)"))), F.lit(0).cast("decimal(34,6)"))
    p = {m: F.greatest(F.coalesce(F.col(m).cast("double"), F.lit(0.0)), F.lit(0.0)) for m in models}
    smape = lambda m: F.when(F.abs(y) + p[m] > 0, 2 * F.abs(y - p[m]) / (F.abs(y) + p[m])).otherwise(0.0)
    sums = [exact(F.abs(y)).alias("y"), *(F.count_if(F.col(part) == s).alias(f"n_{s}") for s in PARTS)]
    for k, m in enumerate(models):
        sums += [exact(F.abs(y - p[m])).alias(f"e{k}"), exact(p[m] - y).alias(f"b{k}"), exact(smape(m)).alias(f"s{k}")]
    leaves = rows.where(y.isNotNull()).groupBy(_path(levels, len(levels)).alias("leaf")).agg(*sums)
    measures = [c for c in leaves.columns if c != "leaf"]
    nodes = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(levels))), lambda d: F.slice("leaf", F.lit(1), d))).alias("path"), *measures).groupBy("path").agg(*(F.sum(c).alias(c) for c in measures))
    ratio = lambda c: F.when(F.col("y") > 0, F.round(F.col(c).cast("double") / F.col("y").cast("double"), 9)).otherwise(F.lit(float("inf")))
    errors = F.array(*(F.struct(ratio(f"e{k}").alias("wape"), F.abs(ratio(f"b{k}")).alias("bias"), F.round(F.col(f"s{k}").cast("double") / F.greatest("n_val", F.lit(1)), 9).alias("smape"), F.lit(m).alias("modelo")) for k, m in enumerate(models)))
    return nodes.select("path", *(f"n_{s}" for s in PARTS), F.array_sort(errors).alias("errors"))


def champions(rows: DataFrame, levels: Sequence[str], part: str, actual: str, models: Sequence[str], least: Sequence[int] = LEAST_ROWS) -> DataFrame:
    """(levels, modelo, modo, n_train, n_val, n_test): the model of each finest segment.

    The model of least WAPE in the validation rows, then of least absolute bias, sMAPE and name. A segment
    with fewer rows than ``least`` in any part takes the model of the nearest segment above that has enough, at last that of all
    rows: ``segment_specific``, ``fallback_parent`` or ``fallback_global``. The test rows are counted, their errors never read.
    """
    nodes = node_errors(rows, levels, part, actual, models)
    enough = F.lit(True)
    for s, n in zip(PARTS, least, strict=True):
        enough = enough & (F.col(f"n_{s}") >= n)
    able = nodes.where(enough | (F.size("path") == 0)).select(F.col("path").alias("above"), F.col("errors")[0]["modelo"].alias("modelo"))
    leaves = nodes.where(F.size("path") == len(levels)).select("path", *(f"n_{s}" for s in PARTS))
    tries = leaves.withColumn("above", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(levels))), lambda d: F.slice("path", F.lit(1), d))))
    best = tries.join(able, "above").groupBy("path", *(f"n_{s}" for s in PARTS)).agg(F.max(F.struct(F.size("above").alias("depth"), "modelo")).alias("b"))
    mode = F.when(F.col("b.depth") == len(levels), "segment_specific").when(F.col("b.depth") > 0, "fallback_parent").otherwise("fallback_global")
    return best.select(*(F.col("path")[k].alias(c) for k, c in enumerate(levels)), F.col("b.modelo").alias("modelo"), mode.alias("modo"), *(f"n_{s}" for s in PARTS))


def routed(rows: DataFrame, chosen: DataFrame, levels: Sequence[str], models: Sequence[str], name: str = "pronostico_qty", fallback: str | None = None) -> DataFrame:
    """``rows`` with the prediction of their segment's model; a segment that wasn't there takes ``fallback``, else the first model."""
    keys = chosen.select(*(F.col(c).alias(f"__{c}") for c in levels), F.col("modelo").alias("__modelo"))
    same = F.lit(True)
    for c in levels:
        same = same & (F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"__{c}"))
    model = F.coalesce("__modelo", F.lit(fallback or models[0]))
    value = F.coalesce(*(F.when(model == m, F.greatest(F.coalesce(F.col(m).cast("double"), F.lit(0.0)), F.lit(0.0))) for m in models))
    return rows.join(keys, same, "left").withColumns({"modelo": model, name: value}).drop("__modelo", *(f"__{c}" for c in levels))
