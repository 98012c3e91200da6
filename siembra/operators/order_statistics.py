"""Exact ranks and percentiles without all values of a group in one task.

Equal values are combined before the shuffle and dealt by ranges of (group, value). Counts by range place each
range among its group's; a rank is then looked for only in the range that holds it. A group that has
a third of all rows lies in a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siembra.sources.scratch import written


def _ranged(df: DataFrame, value: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct values with counts and their range, and the ranges with the rows of the group before them."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    each = written(each.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()), "values")
    sizes = each.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each, sizes.withColumns({"__before": before, "__total": F.sum("__size").over(group)})


def _placed(each: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each value with the rows of the group below it."""
    renamed = ranges.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), "__before", "__total")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__range") == F.col("__r"))
    inside = F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1))
    return each.join(renamed, same).withColumn("__below", F.col("__before") + F.coalesce(inside, F.lit(0)))


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n, below, total): each distinct value, its rows, the rows of smaller values and all rows of the group.

    Null values have no rank, a null key is a group. Nothing in, nothing out.
    """
    each, ranges = _ranged(df, value, keys)
    return _placed(each, ranges, keys).select(*keys, F.col("__v").alias(value), F.col("__n").alias("n"), F.col("__below").alias("below"), F.col("__total").alias("total"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), name: str = "q") -> DataFrame:
    """(keys, q): the percentiles of each group as an array, interpolated between the neighbouring ranks as ``percentile`` does.

    Groups of null values alone have no row; without keys there is always one row, null if there is no value.
    """
    each, ranges = _ranged(df, value, keys)
    at: list[Column] = [(F.col("__total") - 1) * F.lit(float(s)) for s in shares]
    ends = [(F.floor(p), F.ceil(p)) for p in at]
    holds = reduce(or_, (e.between(F.col("__before"), F.col("__before") + F.col("__size") - 1) for pair in ends for e in pair))
    placed = _placed(each, ranges.where(holds), keys)
    has = lambda e: e.between(F.col("__below"), F.col("__below") + F.col("__n") - 1)
    v = F.col("__v").cast("double")
    found = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), *(F.max(F.when(has(e), v)).alias(f"__{k}_{i}") for k, pair in enumerate(ends) for i, e in enumerate(pair)))
    between = [F.when((low == high) | (F.col(f"__{k}_0") == F.col(f"__{k}_1")), F.col(f"__{k}_0")).otherwise((high - p) * F.col(f"__{k}_0") + (p - low) * F.col(f"__{k}_1")) for k, (p, (low, high)) in enumerate(zip(at, ends, strict=True))]
    every = F.array(*between)
    return found.select(*keys, F.when(F.col("__total") > 0, every).alias(name))
