from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siembra.operators.order_statistics import quantiles, value_ranks

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]


def rows(n=3000):
    rng = random.Random(2)
    out = [("hot", 5.0)] * (n // 3) + [("hot", float(rng.randrange(50))) for _ in range(n // 3)]
    out += [(rng.choice(["a", "b", None]), rng.choice([None, -0.5, rng.gauss(0, 1e6), float(rng.randrange(7))])) for _ in range(n // 3)]
    return [*out, ("one", 3.25), ("none", None), ("two", 1.0), ("two", 2.0)]


def test_quantiles_equal_percentile(spark):
    df = spark.createDataFrame(rows(), "k string, v double").repartition(6)
    got = {r["k"]: r["q"] for r in quantiles(df, "v", SHARES, ["k"]).collect()}
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect() if r["q"] is not None}
    assert got.keys() == want.keys() and {"hot", "a", None, "one", "two"} <= got.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
        values = [v for g, v in rows() if g == k and v is not None]
        assert got[k] == pytest.approx(list(np.quantile(values, SHARES)), rel=1e-9)
    assert quantiles(df, "v", SHARES).collect()[0]["q"] == pytest.approx(list(np.quantile([v for _, v in rows() if v is not None], SHARES)), rel=1e-9)


def test_no_values(spark):
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert quantiles(none, "v", [0.5], ["k"]).collect() == [] and [r["q"] for r in quantiles(none, "v", [0.5]).collect()] == [None]
    assert value_ranks(none, "v").collect() == []


def test_ranks(spark):
    df = spark.createDataFrame(rows(), "k string, v double").repartition(5)
    got = {(r["k"], r["v"]): (r["n"], r["below"], r["total"]) for r in value_ranks(df, "v", ["k"]).collect()}
    for k in {k for k, _ in rows()}:
        values = [v for g, v in rows() if g == k and v is not None]
        for v in set(values):
            assert got[k, v] == (values.count(v), sum(x < v for x in values), len(values))
