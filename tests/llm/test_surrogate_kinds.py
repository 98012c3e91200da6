"""Kinds and shapes of surrogates, and a plain-Python twin of the whole operator."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from siembra.llm import pii_surrogates as PS


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("ask Akira Tanaka today", ["Akira", "Tanaka"]), ("ask Priya Sharma", ["Priya", "Sharma"]), ("ask Mr. O'Brien now", ["O'Brien"]), ("Jane Doe's dog", ["Jane", "Doe"]), ("by Marie Dupont-Leroy.", ["Marie", "Dupont-Leroy"]),
        ("pay GB82 WEST 1234 5698 7654 32 now", ["GB82 WEST 1234 5698 7654 32"]), ("pay DE89370400440532013000.", ["DE89370400440532013000"]), ("from 2001:db8::1 to ::1", ["2001:db8::1", "::1"]), ("at 12:30:45 or 10:20", []), ("code AB82 WEST 12AB 56CD 76EF 33", []),
    ],
)
def test_found(text, kinds):
    assert [text[e.start : e.end] for e in PS.detect(text)] == kinds


def test_shapes():
    made = PS.surrogate(b"k", "iban", "GB82WEST12345698765432")
    assert made[:2] == "GB" and PS.iban_valid(made) and made[4:8].isalpha() and made[8:].isdigit()
    assert PS.surrogate(b"k", "name:surname:n:latin", "O'Brien")[1] == "'"
    assert "-" in PS.surrogate(b"k", "name:surname:n:latin", "Dupont-Leroy")
    assert PS._is_ipv6(PS.surrogate(b"k", "ipv6", "2001:db8::1"))


def twin(texts, key):
    """The definition, one entity after another: attempts rise until no surrogate is shared or real."""
    wanted = {x for t in texts for x in PS._wanted(PS.detect(t or ""))}
    attempts = dict.fromkeys(wanted, 0)
    while True:
        made = {x: PS.surrogate(key, *x, attempts[x]) for x in wanted}
        owners = {}
        for x in sorted(wanted, key=lambda x: (attempts[x], x[1])):
            owners.setdefault((x[0], made[x]), x)
        losers = [x for x in wanted if (x[0], made[x]) in wanted or owners[(x[0], made[x])] != x]
        if not losers:
            break
        for x in losers:
            attempts[x] += 1
    return [PS.replace(t or "", PS.detect(t or ""), key, attempts)[0] for t in texts]


def test_equals_the_twin_and_domains_stay_apart(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(3)
    texts = [f"write to joe@{c}.org or ann@{c}.org" for c in letters] + [f"Mr {rng.choice('ABC')}o and 10.0.0.{k % 7}, call 499-555-65{k % 90:02d}" for k in range(60)] + [None, "", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in PS.pseudonymise(df, "key").collect()}
    assert [got[k] for k in range(len(texts))] == twin(texts, b"key")
    domains = Counter(got[k].split("@")[1].split(" ")[0] for k in range(26))
    assert len(domains) == 26 and all(got[k].count("@" + next(d for d in domains if "@" + d + " " in got[k])) == 2 for k in range(26))
    assert not any(f"@{c}.org" == "@" + d for d in domains for c in letters)
