"""The array form of the feature matrix against the windows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siembra.operators import forecast as FC
from siembra.operators import panel as P
from siembra.operators import panel_matrix as PM


def test_equals_the_windows(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(PM, "CELLS", 200)
    rows = [("first", datetime.date(2018, 11, 1), 1.5), ("never", datetime.date(2019, 1, 1), 0.0), ("once", datetime.date(2023, 3, 1), 2.0), ("late", datetime.date(2019, 5, 1), 0.0), ("late", datetime.date(2022, 5, 1), 3.25)]
    for k in range(25):
        share, season = rng.choice([0.1, 0.5, 0.95]), rng.choice([(1, 2, 12), tuple(range(1, 13))])
        rows += [(f"p{k}", datetime.date(y, m, 1), float(rng.choice([0, 1, 2, 7, 0.25]))) for y in range(2018, 2024) for m in season if rng.random() < share]
    panel = spark.createDataFrame(rows, "product_id string, periodo date, target_qty double")
    columns = ["product_id", "periodo", "target_qty", "estado_producto", "es_estacional", "ultima_actividad", *FC.FEATURES]
    want = {(r[0], r[1]): r for r in FC.prepared(P.complete_grid(panel)).select(*columns).collect()}
    got = {(r[0], r[1]): r for r in PM.modelled(panel, FC.FEATURES).collect()}
    assert got.keys() == want.keys() and len(got) > 500
    for k, r in got.items():
        assert r[2:6] == want[k][2:6], k
        assert r[6:] == pytest.approx(want[k][6:], rel=1e-12, abs=1e-12), k
    assert PM.modelled(panel.where(F.lit(False)), FC.FEATURES).collect() == []
    assert "Window" not in PM.modelled(panel, FC.FEATURES)._jdf.queryExecution().optimizedPlan().toString()
