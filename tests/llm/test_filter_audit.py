from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from siembra.llm.filter_audit import audit_filters
from siembra.llm.queries import OP12_SQL

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every order applied to every document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[lang or ""].append(({f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out, shares = [], defaultdict(int)
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                shares[part, f] += len(here)
                out.append((part, "".join(order), step, len(left), len(here), failing - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


WORDS = " ".join(f"w{k}" for k in range(120))
HARD = [
    (1, WORDS, "en"), (2, WORDS, "en"), (2, WORDS, "de"), (3, WORDS + " #", "en"), (4, "A B C\x0bD\x0cE\tF", None), (5, None, ""), (6, "", "en"), (None, WORDS, "en"), (None, None, None), (7, "w " * 50_000, "fr"), (8, "Ünï 😀 | $" * 40, "fr"),
    (9, " \n\t ", "de"), (10, "Word word word x " * 30, "de"), (1, WORDS, "en"), (11, "w " * 50_000, "de"), (12, WORDS.upper(), "en"),
]
MARKS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 1), (12, 0, 1), (99, 1, 1)]


def found(df):
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_equals_every_order_applied(spark):
    docs = spark.createDataFrame(HARD, DOCS).withColumns({c: F.lit("clash") for c in ("part", "mask", "t", "h", "m", "n", "i", "q", "good", "a.b")})
    assert found(audit_filters(docs, spark.createDataFrame(MARKS, LABELS).withColumn("i", F.lit(1)))) == brute(HARD, MARKS)


def test_a_third_share_one_text(spark):
    rows = [(k, WORDS if k % 3 == 0 else f"text {k % 40} $" * (k % 5), ("en", "de")[k % 2]) for k in range(900)]
    marks = [(k, k % 2, k % 7 == 0) for k in range(0, 900, 4)]
    marks = [(a, b, int(c)) for a, b, c in marks]
    assert found(audit_filters(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(marks, LABELS))) == brute(rows, marks)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert found(audit_filters(spark.createDataFrame([], DOCS), none)) == []
    assert found(audit_filters(spark.createDataFrame(HARD, DOCS), none)) == brute(HARD, [])


def test_sql_says_the_same():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", HARD)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", MARKS)
    assert sorted(con.execute(OP12_SQL).fetchall()) == brute(HARD, MARKS)
