from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from siembra.llm.conversation_repair import Repair, repair_damaged

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """(turn, role, text) of one conversation after damage, in order."""
    out = []
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")):
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0d]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) over strings themselves: the least (cost, audit) by (turns done, initials so far mod state)."""
    best = {(0, ""): (0, "", [])}
    order = [(0, "")]

    def offer(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value
            order.append(key)

    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    while order:
        key = order.pop(0)
        (n, state), (cost, audit, made) = key, best[key]
        if cost > 6 * len(rows) + 12:
            continue
        for c in allowed[state]:
            if c != "s" and len(made) < 3 * len(rows) + 3:
                offer((n, c), (cost + 3, audit + "I", [*made, (full[c], "")]))
        if n < len(rows):
            _, role, text = rows[n]
            offer((n + 1, state), (cost + 4, audit + "D", made))
            if marks[n] not in ("blank", "duplicate"):
                cut = 3 * (marks[n] == "truncated")
                for c in allowed[state]:
                    if role[:1] == c:
                        offer((n + 1, c), (cost + cut, audit + "K", [*made, (role, text)]))
                    if c != "s":
                        offer((n + 1, c), (cost + 3 + cut, audit + "R", [*made, (full[c], text)]))
    ends = [best[len(rows), s] for s in ("", "a") if (len(rows), s) in best]
    return min(ends, key=lambda x: x[:2])


def every_sequence(rows, marks, most_inserts):
    """The least (cost, audit) among all edit strings with few insertions, by enumeration."""
    options = []
    for (_, role, _), mark in zip(rows, marks, strict=True):
        cut = 3 * (mark == "truncated")
        edits = [("D", 4, "")]
        if mark not in ("blank", "duplicate"):
            edits += [("K", cut, role[:1]), ("R", 3 + cut, "u"), ("R", 3 + cut, "a")]
        options.append([("I" * k + e, 3 * k + cost, "".join(ins) + i) for e, cost, i in edits for k in range(most_inserts + 1) for ins in product("ua", repeat=k)])
    options.append([("I" * k, 3 * k, "".join(ins)) for k in range(most_inserts + 1) for ins in product("ua", repeat=k)])
    ok = re.compile(r"(s?(ua)+)?\Z")
    return min((sum(x[1] for x in way), "".join(x[0] for x in way)) for way in product(*options) if ok.match("".join(x[2] for x in way)))


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        now = damage([r for r in rows if r[0] == c])
        marks = faults(now)
        turns = {t for t, _, _ in now if t is not None}
        cost, audit, made = cheapest(now, marks)
        pairs = zip(now, now[1:], strict=False)
        out.append((
            c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df):
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in repair_damaged(df).select(*columns).collect()), key=str)


def conversations(n, seed, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "Fine!", "Really?", "cut off", "  ", "", "Yes.  \n", None, "ñandú 😀.", "a. b", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_equals_brute_force(spark):
    rows = conversations(300, 1) + [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("c", "kind", "audit", "key", "copy", "gone", "fault", "a.b")}).repartition(5)
    assert found(df) == brute(rows)


def test_smoke_table(spark):
    from tests.conftest import DATA

    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repeats_a_long_conversation_and_long_texts(spark):
    rng = random.Random(3)
    long = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"Turn {k}!"])) for k in range(400)]
    rows = long + [(2, 0, "user", "long text " * 100_000 + "."), (2, 1, "assistant", "x" * 1_000_000)] + [(3, 0, "user", "Same.")] * 5
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_dropped(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]


@pytest.mark.parametrize("seed", range(40))
def test_edits_equal_enumeration(seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["user", "assistant", "system", "x"]), "") for k in range(rng.randrange(0, 4))]
    marks = [rng.choice(["", "", "truncated", "blank", "duplicate"]) for _ in rows]
    repair = Repair({})
    for (_, role, _), mark in zip(rows, marks, strict=True):
        repair.turn(role[:1], mark)
    assert repair.finish() == every_sequence(rows, marks, 2) == cheapest(rows, marks)[:2]
