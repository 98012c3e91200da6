"""Joins of keys that repeat on both sides: all pairs, shared out evenly."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siembra.operators.relational import left_pairs


def test_one_frequent_key_is_shared_out(spark, tmp_path):
    rows = [(k, "a", "ECO") for k in range(600)] + [(k, "a", "Eco") for k in range(600, 700)] + [(701, "b", "ECO"), (702, None, "ECO"), (704, None, "ECO"), (706, "c", None), (None, "a", "eco")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = entry.queries()["j08_function_keys"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert Counter((r["a"], r["b"]) for r in pairs) == Counter(con.execute(entry.oracle_sql()["j08_function_keys"]).fetchall())
    tasks = Counter(r["task"] for r in pairs)
    assert len(tasks) > 1 and max(tasks.values()) < 0.8 * len(pairs)


def test_packs_of_any_size_give_all_pairs(spark):
    left = spark.createDataFrame([("x", 1), ("x", 2), ("x", None), ("y", 3), (None, 4)], "k string, a long")
    right = spark.createDataFrame([("x", 5), ("x", None), ("x", 5), (None, 6)], "k string, b long")
    expected = Counter((r["a"], r["b"]) for r in left.join(right, "k", "left").collect())
    for size in (1, 2, 128):
        assert Counter((r["a"], r["b"]) for r in left_pairs(left, right, ["k"], "a", "b", size).collect()) == expected
