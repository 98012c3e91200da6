from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from siembra.llm.exact_dedup import drop_copies, exact_dedup, golomb_decode, golomb_encode
from tests.llm.conftest import TEXTS


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(0, 10**6, 997)), [0, 1, 2, 2**61, 2**61 + 1]])
def test_golomb_round_trip(values):
    assert golomb_decode(golomb_encode(np.array(values, np.uint64))).tolist() == values


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return {(i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_against_brute_force(docs, clashing):
    for df in (docs, clashing):
        got = exact_dedup(df).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == expected(TEXTS)
        assert len(got) == len(TEXTS)
        # one row stays for each text, also of repeated rows
        assert sum(r["kept"] for r in got) == len({t or "" for _, t in TEXTS})


def test_empty_table(empty):
    assert exact_dedup(empty).collect() == []
    assert drop_copies(empty).collect() == []


def test_drop_copies_keeps_columns(clashing):
    got = drop_copies(clashing)
    assert got.columns == clashing.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(2, TEXTS[0][1]), (3, TEXTS[2][1]), (5, ""), (6, "uno"), (None, TEXTS[6][1]), (7, TEXTS[7][1]), (8, TEXTS[8][1]), (9, TEXTS[9][1])], key=str)


def test_hot_text(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    got = exact_dedup(df).where("text_sha256 = sha2('hot', 256)").agg({"group_size": "max", "keep_id": "max", "doc_id": "count"}).first()
    assert set(got) == {1000, 2997}
