from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from siembra.functions import dates as D
from siembra.functions import numeric as N
from siembra.functions import text as X


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (X.normalize_product_name, "* ALIÑO FDA 90 GRS. (4488)", "ALINO FDA 90 GRS 4488"),
        (X.extract_product_code, "* ALINO FDA 90 GRS (4488)", "4488"),
        (X.extract_product_code, "x 12345 y 678901", "678901"),
        (X.extract_product_code, None, ""),
        (X.clean_string, "  NaN ", ""),
        (X.normalize_header, " Año / Mes ", "ano mes"),
        (X.normalize_product_name_v3, "Aliño fda 90grs (4488)", "ALINO PREPARADO FUNDA 90 G"),
        (lambda c: X.normalize_product_name_v3(c, ("LO", "4B")), "LO MANI PASTA BOT 1KIL $1.50", "MANI EN PASTA BOTELLA 1 KG"),
        (X.normalize_product_name_legacy, "PT: Ají * 90 GRS ($ 2.50)", "AJI 90 G"),
        (X.item_leaf, "PT:FAM:ITEM (4488)", "ITEM (4488)"),
        (X.item_category, "PT:FAM:ITEM", "FAM"),
        (X.without_prefix, "PP SMART SELECTION: X", "X"),
        (X.product_type, "PP otro", "PP"),
        (X.product_type, "", "OTHER"),
        (X.ean_digits, "77-86 1", "77861"),
        (lambda c: X.zfill(c), "12345", "12345"),
        (lambda c: X.zfill(c), "12", "0012"),
        (lambda c: X.size_signature(c), "SALSA 2 KG FUNDA", "2000 G"),
        (lambda c: X.size_signature(c), "SALSA", ""),
        (lambda c: X.pack_signature(c), "SALSA EN FUNDA 90 G", "FUNDA"),
        (lambda c: X.token_signature(c), "B DE A A", "A A B"),
    ],
)
def test_text(spark, function, value, expected):
    assert one(spark, value, function) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("(1.234,56)", -1234.56), ("1,234.56", 1234.56), ("1.5E3", 1500.0), ("$ 12,5", 12.5), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("1,23,4", 123.4), ("x", None), ("", None), (None, None), ("NaN", None), ("−5", -5.0)],
)
def test_ledger_numbers(spark, value, expected):
    assert one(spark, value, N.parse_ledger_number) == expected


@pytest.mark.parametrize(("value", "expected"), [("1,5", 1.5), ("1.234.5", 1234.5), ("2e3", 2000.0), ("junk", None), (" 7 ", 7.0), (None, None)])
def test_numbers(spark, value, expected):
    assert one(spark, value, N.parse_number) == expected


def test_decimals_clip_and_drop_infinities(spark):
    rows = spark.createDataFrame([(1e9,), (float("inf"),), (float("nan"),), (2.345,), (-1e9,)], "c double").select(N.to_decimal(F.col("c"), 7, 2).cast("double").alias("x")).collect()
    assert [r["x"] for r in rows] == [99999.99, None, None, 2.34, -99999.99]


def test_history_cap(spark):
    df = spark.createDataFrame([(100.0, 10.0), (5.0, 10.0), (7.0, 0.0), (float("nan"), 1.0), (-3.0, 2.0)], "p double, h double")
    assert [r[0] for r in df.select(N.history_cap(F.col("p"), F.col("h"))).collect()] == [30.0, 5.0, 7.0, 0.0, 0.0]


@pytest.mark.parametrize(("value", "expected"), [("2024-3-5", "2024-03-05"), ("5/3/2024", "2024-03-05"), ("45356", "2024-03-05"), ("nada", None), (None, None)])
def test_dates(spark, value, expected):
    got = one(spark, value, D.parse_date)
    assert (str(got) if got else None) == expected


def test_months(spark):
    df = spark.createDataFrame([("2024", "Setiembre "), ("x", "mayo"), ("2024", "foo")], "y string, m string")
    assert [str(r[0]) if r[0] else None for r in df.select(D.month_start(F.col("y"), F.col("m"))).collect()] == ["2024-09-01", None, None]
    row = spark.sql("select date'2024-12-01' as d").select(*(c.alias(k) for k, c in D.calendar(F.col("d")).items())).first()
    assert row["quarter"] == 4
    assert math.isclose(row["month_cos"], 1.0)


def test_classes(spark):
    df = spark.createDataFrame([(0.15,), (0.02,), (5.0,), (20.0,)], "x double")
    got = df.select(N.bucket(F.col("x"), [(0.15, "C"), (0.03, "M")], "B"), N.right_closed(F.col("x"), [5, 10], ["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [("C", "a"), ("B", "a"), ("C", "a"), ("C", "c")]


def test_safety_stock(spark):
    assert N.z_score_of(0.94) == 1.6449
    assert one(spark, 2.0, lambda c: N.to_lot(c), "double") == 5
