from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

#: One query of each kind; the whole set is compared by the driver.
NAMES = ["g01_kpi_rollup", "g05_commercial_indicators", "d26_pareto", "j01_full_outer", "j17_point_in_period", "r04_grid_completion", "w09_point_in_time_profile", "w24_stock_projection", "m02_association_rules", "d20_decisions", "x01_stream_windows"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    expected = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(expected), check_dtype=False, rtol=1e-9)
