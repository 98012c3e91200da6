from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siembra.llm.bit_sliced_search import Block, add_slices, at_least, kth_best, sliced, top_k

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=10, step=100, scale=1024):
    """Every pair scored with Python's integers."""
    sound = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted((r for r in sound if r[0] is not None and r[0] % step == 0), key=lambda r: (r[0], r[1])):
        asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, w in sound if i != q))[:k]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in top_k(df, **more).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force(spark, partitions):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.12, 24).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert found(df) == brute(rows)
    assert found(df, k=3, step=50) == brute(rows, k=3, step=50)


def test_a_third_of_all_vectors_are_equal(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(0, 0.12, 16).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(0, 0.12, 16).tolist()) for i in range(900)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_hard_rows(spark):
    rows = [
        (0, [1.0, -2.0, 0.5]), (100, [0.0, 0.0, 0.0]), (200, [-0.25, 3.0]), (300, []), (400, None), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 0.0, 0.0]),
        (1, [0.0001, -0.0001, 9.0]), (2, [1.0, -2.0, 0.5]), (2, [1.0, -2.0, 0.5]), (None, [1.0, -2.0, 0.5]), (None, [5.0, -5.0, 5.0, 5.0]), (0, [0.5, 0.5, 0.5]), (-100, [60000.0, -60000.0, 1.0]), (3, [1e30, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "rank", "slot", "v", "query_id", "ids", "a.b")})
    assert found(df) == brute([r for r in rows if r[0] != 3])  # beyond the largest component: takes no part
    assert found(df, k=2) == brute([r for r in rows if r[0] != 3], k=2)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(0, 1, 1, 4 * 1024 * 1024)]
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_slices_add_and_select():
    rng = np.random.default_rng(7)
    values = rng.integers(-300, 300, (1000, 5))
    low, bits, slices = sliced(values)
    assert low == values.min()
    by_weight = {b: slices[:, b] for b in range(bits)}
    sums = add_slices(by_weight, 0, slices.shape[2])
    exact = (values - low).sum(1)
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << p for p, s in enumerate(sums))
    assert (got[:1000] == exact).all()
    rows = np.packbits(np.r_[np.ones(1000, np.uint8), np.zeros(24, np.uint8)], bitorder="little").view(np.uint64)
    for k in (1, 10, 999):
        value = kth_best(sums, rows, k)
        assert value == np.sort(exact)[-k]
        above = np.unpackbits(at_least(sums, rows, value).view(np.uint8), bitorder="little")[:1000]
        assert (above == (exact >= value)).all()


def test_few_rows_are_scored_exactly():
    """The bound keeps the boundary small: a block doesn't fall back to scoring all of its rows."""
    rng = np.random.default_rng(8)
    values = np.floor(1024 * rng.normal(0, 0.125, (20_000, 64))).astype(np.int64)
    low, bits, slices = sliced(values)
    block, asked = Block(20_000, 64, low, bits, np.arange(20_000), 0, slices), []
    block.scores = lambda q, places, scores=block.scores: asked.append(len(places)) or scores(q, places)
    for i in range(0, 20_000, 2000):
        places, scores = block.best(i, values[i], 10)
        exact = values @ values[i]
        exact[i] = exact.min()
        assert (scores == np.sort(exact)[::-1][:10]).all()
    assert max(asked) < 200
