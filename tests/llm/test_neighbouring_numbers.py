from __future__ import annotations

import pytest

from siembra.llm import pii_surrogates as PS

CARD, SPACED, SSN, PHONE = "4465758382889437", "4111 1111 1111 1111", "123-45-6789", "499-555-6503"


@pytest.mark.parametrize(
    "parts",
    [
        [("card", CARD), ("card", CARD)], [("card", SPACED), ("card", SPACED)], [(None, "12"), ("card", SPACED)], [("card", SPACED), (None, "12")], [("ssn", SSN), ("phone", PHONE)], [("phone", PHONE), ("ssn", SSN)],
        [("phone", PHONE), ("phone", PHONE)], [("phone", "(499) 555-6503"), ("phone", "(499) 555-6504")], [("phone", "+1 (499) 555-6503"), ("card", SPACED), ("ssn", SSN)], [("ssn", SSN), ("ssn", SSN), ("ssn", SSN)],
        [(None, "7"), ("card", CARD), (None, "8"), ("ssn", SSN)], [("card", "4111-1111-1111-1111"), ("card", CARD)], [("card", "1234567812345678"), ("card", "1234567812345678")], [("card", SPACED)], [("ssn", SSN)],
    ],
)
@pytest.mark.parametrize("between", [" ", "  "])
def test_each_is_found(parts, between):
    text = "see " + between.join(x for _, x in parts) + " here"
    found = [(e.kind, text[e.start : e.end]) for e in PS.detect(text)]
    assert found == [(k, x) for k, x in parts if k]


def test_none_stays_in_clear(spark):
    rows = [(1, f"{CARD} {CARD}"), (2, f"paid 12 {SPACED}, {SSN} {PHONE}"), (3, "totals 10 20 30 40 50 60 70 80 90 100 110")]
    got = {r["doc_id"]: r["text"] for r in PS.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert not any(x in t for x in (CARD, SPACED, SSN, PHONE) for t in got.values())
    first, second = got[1].split(" ")
    assert first == second and PS.luhn(first)
    assert got[2].startswith("paid 12 ")
    assert got[3] == rows[2][1]
