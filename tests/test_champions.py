from __future__ import annotations

import random

from pyspark.sql import functions as F

from siembra.operators import champions as CH

SCHEMA = "tipo string, cat string, parte string, y double, m1 double, m2 double, m3 double"
LEVELS, MODELS = ["tipo", "cat"], ["m1", "m2", "m3"]


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for tipo, cat, sizes in (("PT", "a", (70, 12, 11)), ("PT", "b", (59, 30, 30)), ("PT", "c", (80, 9, 20)), ("PP", "a", (5, 3, 2)), (None, "x", (90, 15, 15)), ("PP", None, (70, 20, 9))):
        for part, n in zip(CH.PARTS, sizes, strict=True):
            for _ in range(n):
                y = float(rng.randrange(0, 20))
                out.append((tipo, cat, part, y, y + rng.choice([-3.0, 3.0]), None if rng.random() < 0.1 else y * rng.choice([0.8, 1.3]), y + rng.gauss(-2, 2)))
    return [*out, ("PT", "a", "val", None, 1e9, 1e9, 1e9)]


def winner(part):
    """The best model of some rows, from the rows themselves."""
    val = [r for r in part if r[2] == "val"]
    total = sum(r[3] for r in val)
    found = []
    for k, m in enumerate(MODELS):
        p = [max(r[4 + k] or 0.0, 0.0) for r in val]
        e = [(a, r[3]) for a, r in zip(p, val, strict=True)]
        smape = sum(2 * abs(a - y) / (a + y) if a + y > 0 else 0 for a, y in e) / max(1, len(e))
        found.append((sum(abs(a - y) for a, y in e) / total if total else float("inf"), abs(sum(a - y for a, y in e)) / total if total else float("inf"), smape, m))
    return min((round(a, 9), round(b, 9), round(c, 6), m) for a, b, c, m in found)[3]


def test_winners_and_back_off(spark):
    for seed in (1, 2, 3):
        data = rows(seed)
        got = {(r["tipo"], r["cat"]): r for r in CH.champions(spark.createDataFrame(data, SCHEMA).repartition(4), LEVELS, "parte", "y", MODELS).collect()}
        known = [((r[0] or "", r[1] or ""), r) for r in data if r[3] is not None]
        assert got.keys() == {k for k, _ in known}
        for (tipo, cat), r in got.items():
            size = lambda part: [sum(x[2] == s for x in part) for s in CH.PARTS]
            able = lambda part: all(n >= m for n, m in zip(size(part), CH.LEAST_ROWS, strict=True))
            own, above, whole = [x for k, x in known if k == (tipo, cat)], [x for k, x in known if k[0] == tipo], [x for _, x in known]
            used, mode = (own, "segment_specific") if able(own) else (above, "fallback_parent") if able(above) else (whole, "fallback_global")
            assert (r["modelo"], r["modo"], [r["n_train"], r["n_val"], r["n_test"]]) == (winner(used), mode, size(own))


def test_routing_takes_the_segments_model(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    chosen = CH.champions(df, LEVELS, "parte", "y", MODELS)
    names = {(r["tipo"], r["cat"]): r["modelo"] for r in chosen.collect()}
    new = spark.createDataFrame([("ZZ", "z", "test", 1.0, -5.0, 2.0, 3.0)], SCHEMA)
    for r in CH.routed(df.where("y IS NOT NULL").unionByName(new), chosen, LEVELS, MODELS, fallback="m1").collect():
        model = names.get((r["tipo"] or "", r["cat"] or ""), "m1")
        assert r["modelo"] == model and r["pronostico_qty"] == max(r[model] or 0.0, 0.0)


def test_no_rows_and_no_volume(spark):
    assert CH.champions(spark.createDataFrame([], SCHEMA), LEVELS, "parte", "y", MODELS).collect() == []
    still = spark.createDataFrame([("PT", "a", "val", 0.0, 1.0, 0.0, 2.0)] * 3, SCHEMA).withColumn("path", F.lit("clash"))
    assert [(r["modelo"], r["modo"]) for r in CH.champions(still, LEVELS, "parte", "y", MODELS).collect()] == [("m2", "fallback_global")]
