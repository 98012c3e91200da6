from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siembra.operators import mining as M
from siembra.operators import rule_stability as RS


def lines(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        items = {i for i in "ABCDEF" if rng.random() < 0.35} | ({"A", "B"} if rng.random() < 0.3 else set())
        out += [(k, i, ("train", "val", "test")[(k % 10 > 5) + (k % 10 > 7)]) for i in items]
    return [*out, (None, "A", "train"), (3, None, "train"), (3, "nan", "train")]


def rules_of(baskets):
    """Directed rules of weighted baskets: (support, confidence, lift)."""
    n = sum(w for _, w in baskets)
    count = lambda *items: sum(w for b, w in baskets if set(items) <= b)
    items = sorted({i for b, _ in baskets for i in b})
    out = {}
    for a in items:
        for b in items:
            if a != b and count(a, b):
                out[a, b] = (count(a, b) / n, count(a, b) / count(a), count(a, b) * n / (count(a) * count(b)))
    return out


def grouped(rows):
    found = {}
    for k, i, s in rows:
        if k is not None and i not in (None, "nan"):
            found.setdefault(k, (set(), s))[0].add(i)
    return {k: v for k, v in found.items() if len(v[0]) >= 2}


def test_resamples_equal_explicit_ones(spark):
    rows = lines()
    df = spark.createDataFrame(rows, "k long, i string, s string").repartition(5)
    pairs = M.baskets(df, "k", "i")
    found = RS.bootstrap(pairs, "k", "i", 12, 0.12, 0.45)
    got = {(r["antecedent"], r["consequent"]): (r["en_base"], r["estabilidad"]) for r in found.collect()}
    weights = {r["k"]: r["w"] for r in spark.range(400).select(F.col("id").alias("k"), F.array(*(RS.poisson_weight(F.col("id"), r) for r in range(12))).alias("w")).collect()}
    baskets = grouped(rows)
    keep = lambda rules: {k for k, (s, c, _) in rules.items() if s >= 0.12 and c >= 0.45}
    base = keep(rules_of([(b, 1) for b, _ in baskets.values()]))
    sets = [keep(rules_of([(b, weights[k][r]) for k, (b, _) in baskets.items()])) for r in range(12)]
    want = {rule: (rule in base, sum(rule in s for s in sets) / 12) for rule in base.union(*sets)}
    assert got == want and any(0 < share < 1 for _, share in want.values())
    near = {r["muestra"]: r["jaccard"] for r in RS.jaccard_by_resample(found).collect()}
    assert near == {r: pytest.approx(len(base & s) / len(base | s)) for r, s in enumerate(sets)}


def test_weights_are_poisson(spark):
    w = [r["w"] for r in spark.range(20_000).select(RS.poisson_weight(F.col("id"), 3).alias("w")).collect()]
    assert abs(sum(w) / len(w) - 1) < 0.03 and abs(sum(x * x for x in w) / len(w) - 2) < 0.1


def test_consensus_equals_the_definition(spark):
    rows = lines(seed=2)
    df = spark.createDataFrame(rows, "k long, i string, s string")
    got = {(r["antecedent"], r["consequent"]): r for r in RS.consensus(df, "k", "i", "s", 0.05, 0.3, 0.3, 0.3, 0.05).collect()}
    by = {s: rules_of([(b, 1) for b, part in grouped(rows).values() if part == s]) for s in RS.SPLITS}
    kept = {}
    for rule, (s, c, lift) in by["train"].items():
        val, test = (by[x].get(rule, (0, 0, 0)) for x in ("val", "test"))
        if s >= 0.05 and c >= 0.3 and val[1] >= 0.3 and test[1] >= 0.3 and max(val[0], test[0]) >= 0.05:
            kept[rule] = (lift, c, test[1], sum(x[0] >= 0.05 and x[1] >= 0.3 for x in (val, test)) / 2)
    assert got.keys() == kept.keys() and len(kept) > 5

    def place(k, rule):
        values = [round(v[k], 9) for v in kept.values()]
        mine = round(kept[rule][k], 9)
        return (sum(v < mine for v in values) + (values.count(mine) + 1) / 2) / len(values)

    for rule, (_, _, _, stable) in kept.items():
        assert got[rule]["score_consenso"] == pytest.approx(0.3 * place(0, rule) + 0.25 * place(1, rule) + 0.25 * place(2, rule) + 0.2 * stable, abs=1e-8)


def test_no_baskets(spark):
    none = spark.createDataFrame([], "k long, i string, s string")
    assert RS.consensus(none, "k", "i", "s").collect() == [] and RS.bootstrap(M.baskets(none, "k", "i"), "k", "i", 3).collect() == []
