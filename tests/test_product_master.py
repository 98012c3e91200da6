"""The master after any order of batches against one full recompute, late months, replays, conflicts and the gate."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from siembra.operators import product_master as M
from siembra.plans.identity import sku_master

SCHEMA = "codigo_producto string, producto_dashboard string, tipo_producto string, categoria_producto string, periodo date, qty_vendida double"


def base(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def recomputed(rows):
    """Runs of dominant names by a plain loop over all rows."""
    sums = defaultdict(Counter)
    for code, name, _, _, month, qty in rows:
        if code and month:
            sums[code, month][(name or "").upper()] += qty or 0
    names = {k: min(c, key=lambda n: (-c[n], n)) for k, c in sums.items()}
    out = []
    for code in sorted({k[0] for k in names}):
        runs = []
        for month in sorted(m for c, m in names if c == code):
            name = names[code, month]
            if runs and runs[-1][0] == name:
                runs[-1][2] = month
            else:
                runs.append([name, month, month])
        for i, (name, a, b) in enumerate(runs, 1):
            sku = f"SKU_{code}" if len(runs) == 1 else f"SKU_{code}_V{i}"
            out.append((sku, name, a, b, i == len(runs), "MEDIA" if len(runs) > 1 else "ALTA"))
    return sorted(out)


def rows_of(master):
    return sorted((r.sku_id, r.producto_canonico, r.vigente_desde, r.vigente_hasta, r.activo, r.calidad_sku) for r in master.published().collect() if r.codigo_producto)


def test_late_months_split_extend_and_join_runs(spark, tmp_path):
    month = lambda m: date(2024, m, 1)
    row = lambda m, name, qty=1.0: ("1", name, "PT", "C", month(m), qty)
    batches = [[row(3, "a"), row(6, "a"), row(9, "b")], [row(5, "b")], [row(4, "b")], [row(1, "b")], [row(9, "a", 5.0)], [row(5, "a", 7.0), row(4, "a", 7.0)]]
    expected = [[("a", 3, 6), ("b", 9, 9)], [("a", 3, 3), ("b", 5, 5), ("a", 6, 6), ("b", 9, 9)], [("a", 3, 3), ("b", 4, 5), ("a", 6, 6), ("b", 9, 9)]]
    expected += [[("b", 1, 1), ("a", 3, 3), ("b", 4, 5), ("a", 6, 6), ("b", 9, 9)], [("b", 1, 1), ("a", 3, 3), ("b", 4, 5), ("a", 6, 9)], [("b", 1, 1), ("a", 3, 9)]]
    master = M.ProductMaster(spark, str(tmp_path / "m"))
    for k, (rows, want) in enumerate(zip(batches, expected)):
        assert master.absorb(base(spark, rows), f"b{k}")
        got = sorted(master.runs().collect(), key=lambda r: r.desde)
        assert [(r.nombre, r.desde.month, r.hasta.month) for r in got] == [(n.upper(), a, b) for n, a, b in want]
        assert [r.antes for r in got] == [None, *(r.hasta for r in got[:-1])]
        assert [r.despues for r in got] == [*(r.desde for r in got[1:]), None]


def test_any_order_of_batches_gives_the_full_recompute(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["7", "8", "9", "", None]), rng.choice(["x", "y", "z", "", None]), rng.choice(["PT", "PP", None]), rng.choice(["K", None]), date(2023, rng.randint(1, 12), 1), rng.choice([0.0, 1.0, 2.5, -1.0, None])) for _ in range(160)]
    parts = [rows[k::3] for k in range(3)]
    want, whole = recomputed(rows), None
    for n, order in enumerate(list(permutations(range(3)))[::2]):
        master = M.ProductMaster(spark, str(tmp_path / f"m{n}"))
        for k in order:
            master.absorb(base(spark, parts[k]), f"part-{k}")
        assert rows_of(master) == want
        everything = sorted(map(str, master.published().collect()))
        assert whole is None or everything == whole
        whole = everything


def test_replays_interrupted_and_empty_batches(spark, tmp_path):
    rows = [("1", "a", "PT", "C", date(2024, 1, 1), 1.0), ("1", "b", "PT", "C", date(2024, 2, 1), 1.0), ("1", "c", "PT", "C", None, 9.0)]
    master = M.ProductMaster(spark, str(tmp_path / "m"))
    assert master.published().count() == 0
    M.sums(M.tidy(base(spark, [("1", "z", "PT", "C", date(2024, 1, 1), 50.0)]))).withColumn("anio", F.year("periodo")).write.partitionBy("anio").parquet(str(tmp_path / "m/sums/batch=lost"))
    assert master.absorb(base(spark, rows), "one")
    assert not master.absorb(base(spark, rows), "one")
    assert master.absorb(base(spark, []), "none")
    assert rows_of(master) == recomputed(rows)
    assert master.absorb(base(spark, [("1", "z", "PT", "C", date(2024, 1, 1), 0.5)]), "lost")
    assert [r[1] for r in rows_of(master)] == ["A", "B"]
    with pytest.raises(ValueError):
        master.absorb(base(spark, rows), "a/b")


def test_rows_get_their_identity(spark, tmp_path):
    rows = [("1", "a", "PT", "C", date(2024, 1, 1), 2.0), ("1", "b", "PT", "C", date(2024, 1, 1), 1.0), ("1", "b", "PP", "C", date(2024, 2, 1), 1.0), ("", "ñ", None, None, date(2024, 2, 1), 1.0), (None, None, None, None, date(2024, 2, 1), 1.0)]
    master = M.ProductMaster(spark, str(tmp_path / "m"))
    master.absorb(base(spark, rows), "one")
    got = {(r.codigo, r.nombre, r.periodo.month): (r.sku_id, r.calidad_sku) for r in M.identified(M.tidy(base(spark, rows)), master.runs()).collect()}
    assert got["1", "A", 1] == got["1", "B", 1] == ("SKU_1_V1", "MEDIA")
    assert got["1", "B", 2] == ("SKU_1_V2", "MEDIA")
    assert got["", "N", 2][0].startswith("NO_CODE_") and got["", "N", 2][1] == "BAJA"
    assert got["", "", 2] == (None, "BAJA")
    loose = [r for r in master.published().collect() if not r.codigo_producto]
    assert [(r.producto_canonico, r.tipo_producto, r.categoria_producto, r.activo) for r in loose] == [("N", "OTRO", "SIN_CATEGORIA", True)]


def test_conflicts_and_gate(spark):
    clean = [(str(k), "a", "PT", "C", date(2024, 1, 1), 1.0) for k in range(50)]
    added = lambda rows: M.sums(M.tidy(base(spark, rows)))
    assert M.quality_gate(added(clean)).first().status_calidad == "PASS"
    M.require_quality(M.quality_gate(added(clean)))
    assert M.quality_gate(added([])).first().status_calidad == "PASS"
    two = [*clean, ("1", "b", "PT", "C", date(2024, 3, 1), 1.0), ("2", "b", "PT", "C", date(2024, 1, 1), 1.0), ("2", "c", "PT", "C", date(2024, 1, 1), 1.0)]
    assert M.quality_gate(added(two)).first().status_calidad == "WARNING"
    found = {r.codigo_producto: (r.nombres_distintos, r.nombres_detectados, r.recomendacion, r.periodo_max) for r in M.code_conflicts(added(two)).collect()}
    assert found == {"1": (2, "A | B", "REVISAR_MERGE", date(2024, 3, 1)), "2": (3, "A | B | C", "REVISAR_SPLIT", date(2024, 1, 1))}
    bare = [*clean, *[("", None, None, None, date(2024, 1, 1), 1.0)] * 4]
    gate = M.quality_gate(added(bare))
    assert gate.first().status_calidad == "FAIL" and gate.first().pct_nombres_no_mapeados == 4 / 54
    with pytest.raises(RuntimeError):
        M.require_quality(gate)
    mapped = {(r.codigo_producto, r.nombre_original): (r.nombre_canonico, r.decision_sugerida) for r in M.name_mapping(M.tidy(base(spark, two))).collect()}
    assert mapped["2", "c"] == ("A", "MANUAL_REVIEW") and mapped["3", "a"] == ("A", "AUTO_MERGE")


def test_a_batch_normalises_spellings_not_rows(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def upper(name):
        calls.add(1)
        return (name or "").upper()

    rows = [("1", name, "PT", "C", date(2024, m, d), 1.5) for name in ("a", "b", None) for m in (1, 2) for d in range(1, 21)]
    master = M.ProductMaster(spark, str(tmp_path / "m"))
    master.absorb(base(spark, rows), "one", F.udf(upper, "string"))
    assert 6 <= calls.value <= 12
    assert sorted((r.nombre, r.periodo.month, float(r.qty), r.filas) for r in master.sums().collect()) == [(n, m, 30.0, 20) for n in ("", "A", "B") for m in (1, 2)]


def test_condensed_rows_give_the_same_sums_gate_and_spellings(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["7", " 7", "8", "", None]), rng.choice(["x", "X", "ñ", "", None]), rng.choice(["PT", "PP", None]), rng.choice(["K", None]), rng.choice([date(2023, rng.randint(1, 3), rng.randint(1, 28)), None]), rng.choice([9e13, 1.0, -2.5, 1e15, float("nan"), None])) for _ in range(300)]
    plain, once = base(spark, rows), M.condensed(base(spark, rows))
    assert once.count() < 300 and once.agg(F.sum("filas")).first()[0] == 300
    columns = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for rest in (lambda b: M.sums(M.tidy(b)), lambda b: M.quality_gate(M.sums(M.tidy(b))), lambda b: M.name_mapping(M.tidy(b)), lambda b: M.code_conflicts(M.sums(M.tidy(b)))):
        assert columns(rest(once)) == columns(rest(plain)) == columns(rest(M.condensed(once)))


def test_lines_without_number_count_in_the_master(spark, tmp_path):
    spark.createDataFrame([(1, "hot bolt", "SMALL", "Brand#1")], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(1, 2.0, datetime(1996, 1, 5), 1), (1, 3.0, datetime(1997, 2, 5), None)]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_shipdate timestamp, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r.producto_canonico, r.vigente_desde, r.vigente_hasta) for r in sku_master(spark, str(tmp_path)).collect()] == [("HOT BOLT Y CO", "1996-01-01", "1997-02-01")]
