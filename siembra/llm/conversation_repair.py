"""Conversation repair: the cheapest edits that make the roles alternate, the first of equals by their audit string.

Roles have to spell ``(s?(ua)+)?``, so what may stand next follows from a state of four: nothing yet,
after the system turn, after a user, after an assistant. Edits are grouped into macros, each a
run of insertions and then what becomes of one turn: ``K``, ``D``, ``R``, ``IK``, ... No macro is the start of
another, so two sequences of as many macros differ at a macro, and comparing them as strings is
comparing them macro by macro. A layer of the dynamic program (one per turn) therefore keeps no
strings: by state the cost, the rank of its string among the layer's strings and a pointer to the state
before. Ranks of the next layer come from (rank before, order of the macro). The string is spelled
once, at the end, along the pointers.

Costs relative to the layer's cheapest are small numbers, so there are few different layers, and a step
from layer to layer is looked up by (layer, kind of turn) once it is known.

Turns come to a task in order, as a stream sorted by Spark: first without texts (a byte or so a turn, and 16 bytes of
a hash to know repeated turns), then, when the edits are known, with texts for the hash of the repaired
conversation. No conversation's texts are ever held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bound_batches, give_back, named

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
_BLANK = r"[ \t\n\x0B\f\r]"
_USER, _ASSISTANT = "u", "a"
#: State: the initials that may stand next, with the state each leads to.
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
STATES = tuple(NEXT)
#: States in which a conversation may end.
ENDS = ("", "a")
#: Longest run of insertions: two turns lead back to the same state, so a third never pays.
RUN = 2


def _inserted(state: str) -> str:
    """The state after an inserted turn: assistant after user, else user."""
    return "a" if state == "u" else "u"


def macros(state: str, kind: tuple[str, str]) -> Iterator[tuple[str, str, int]]:
    """(macro, next state, cost) of a turn of the kind (initial, fault) after ``state``."""
    initial, fault = kind
    for run in range(RUN + 1):
        head, cost = "I" * run, INSERT * run
        yield head + "D", state, cost + DELETE
        if fault not in ("blank", "duplicate"):
            cut = CUT if fault == "truncated" else 0
            if initial in NEXT[state]:
                yield head + "K", NEXT[state][initial], cost + cut
            yield head + "R", _inserted(state), cost + REROLE + cut
        state = _inserted(state)


class Repair:
    """The layers of one conversation; ``steps`` is shared by the conversations of a task."""

    __slots__ = ("cost", "layer", "path", "steps")
    #: A layer: by state (cost above the cheapest, rank of the string), None where no edit leads.
    START = ((0, 0), None, None, None)

    def __init__(self, steps: dict):
        self.steps, self.layer, self.cost, self.path = steps, self.START, 0, []

    def turn(self, initial: str, fault: str) -> None:
        key = (self.layer, initial if initial in ("s", "u", "a") else "", fault)
        step = self.steps.get(key)
        if step is None:
            step = self.steps[key] = self._step(*key)
        self.layer, more, pointers = step
        self.cost += more
        self.path.append(pointers)

    @staticmethod
    def _step(layer: tuple, initial: str, fault: str) -> tuple:
        best: dict[str, tuple] = {}
        for k, entry in enumerate(layer):
            if entry is not None:
                for macro, to, cost in macros(STATES[k], (initial, fault)):
                    found = (entry[0] + cost, entry[1], macro, k)
                    if to not in best or found < best[to]:
                        best[to] = found
        least = min(found[0] for found in best.values())
        rank = {to: r for r, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        layer = tuple((best[s][0] - least, rank[s]) if s in best else None for s in STATES)
        return layer, least, tuple(best[s][2:] if s in best else None for s in STATES)

    def finish(self) -> tuple[int, str]:
        """Cost and audit string of the whole conversation."""
        ways = []
        for k, entry in enumerate(self.layer):
            state = STATES[k]
            for run in range(RUN + 1 if entry is not None else 0):
                if state in ENDS:
                    ways.append((entry[0] + INSERT * run, entry[1], "I" * run, k))
                state = _inserted(state)
        cost, _, tail, k = min(ways)
        spelled = [tail]
        for pointers in reversed(self.path):
            macro, k = pointers[k]
            spelled.append(macro)
        return self.cost + cost, "".join(reversed(spelled))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (c, turn, r0, t0, copy, gone, role, text) after the contract's damage by crc32(conv:turn) mod 20; dropped rows stay as ``gone``.

    Nulls become one space, in the key of the damage as well; the turn itself stays null. Rows of one turn
    stand by role and text as they were, each repeat beside its own.
    """
    space = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    rows = df.select(named(conv_col).alias("c"), named(turn_col).alias("turn"), space(role_col).alias("r0"), space(text_col).alias("t0"), (F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20).cast("int").alias("hit"))
    rows = rows.select("*", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("t0", ".!?", "")).otherwise(F.col("t0"))
    return rows.select("c", "turn", "r0", "t0", "copy", (F.col("hit") == 0).alias("gone"), F.when(F.col("hit") == 4, "user").otherwise(F.col("r0")).alias("role"), text.alias("text"))


def _fault(text: Column) -> Column:
    """blank or truncated; repeats are known only in order."""
    return F.when(~text.rlike(r"[^ \t\n\x0B\f\r]"), "blank").when(~text.rlike(rf"[.!?]{_BLANK}*\z"), "truncated").otherwise("")


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("c", *first, "turn", "r0", "t0", "copy")]
    return df.repartition("c").sortWithinPartitions(*order)


def _schema(conv: T.DataType, *more: T.StructField) -> T.StructType:
    counts = [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return T.StructType([T.StructField("c", conv), *counts, T.StructField("audit", T.StringType()), *more])


_LEGAL = {"su", "ua", "au"}


def _edits(schema: pa.Schema):
    """Sorted turns without texts into one row a conversation: counts, cost and audit string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict = {}
        made: list[tuple] = []
        conv, repair = None, None
        seen: set = set()

        def close() -> None:
            cost, audit = repair.finish()
            made.append((conv, high - low + 1 - turns if turns else 0, *(faults[f] for f in ("blank", "duplicate", "truncated")), illegal, cost, audit))

        for batch in batches:
            for c, turn, gone, initial, fault, key in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "gone", "initial", "fault", "key")), strict=True):
                if repair is None or c != conv:
                    if repair is not None:
                        close()
                    conv, repair, before, illegal, turns, low, high = c, Repair(steps), None, 0, 0, None, None
                    faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
                    seen = set()
                if gone:
                    continue
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if fault != "blank":
                    if key in seen:
                        fault = "duplicate"
                    seen.add(key)
                faults[fault] += 1
                illegal += before is not None and before + initial not in _LEGAL
                before = initial
                repair.turn(initial, fault)
            if len(made) > 4096:
                yield _batch(made, schema)
                made = []
        if repair is not None:
            close()
        if made:
            yield _batch(made, schema)
        give_back()

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Digest:
    """SHA-256 of a repaired conversation, turn by turn along its audit string."""

    __slots__ = ("at", "audit", "hash", "last", "any")

    def __init__(self, audit: str):
        self.audit, self.at, self.hash, self.last, self.any = audit, 0, hashlib.sha256(), "", False

    def _put(self, role: str, text: str, state: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any, self.last = True, state

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(*(("assistant", "", "a") if self.last == "u" else ("user", "", "u")))
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text, role[:1])
        elif edit == "R":
            self._put(*(("assistant", text, "a") if self.last == "u" else ("user", text, "u")))

    def finish(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def _hashes(schema: pa.Schema):
    """Each conversation's edits (kind 0) and then its turns with texts (kind 1) into the edits with the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        head, digest = None, None
        names = schema.names[:-1]
        for batch in batches:
            kinds, roles, texts = (batch.column(x).to_pylist() for x in ("kind", "role", "text"))
            for k, kind in enumerate(kinds):
                if kind == 0:
                    if head is not None:
                        made.append((*head, digest.finish()))
                    head = tuple(batch.column(x)[k].as_py() for x in names)
                    digest = _Digest(head[-1])
                else:
                    digest.turn(roles[k], texts[k])
            if len(made) > 4096:
                yield _batch(made, schema)
                made = []
        if head is not None:
            made.append((*head, digest.finish()))
        if made:
            yield _batch(made, schema)
        give_back()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``damaged`` rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without an id is one of its own. One without rows has zeros, an empty audit and the hash of
    nothing; no conversations give no rows. Turns without a number come first. Long texts pass one by one; a
    conversation of any length is a stream, of which a task keeps some 60 bytes a turn. Initials are
    first characters of roles: ``unknown`` stands as a user, another than s, u, a never as it is.
    """
    bound_batches(rows.sparkSession)
    conv = rows.schema["c"].dataType
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32))
    narrow = _in_order(rows).select("c", "turn", "gone", F.substring("role", 1, 1).alias("initial"), _fault(F.col("text")).alias("fault"), key.alias("key"))
    schema = _schema(conv)
    edits = narrow.mapInArrow(_edits(_arrow(schema)), schema)
    turn = rows.schema["turn"].dataType
    none = lambda t: F.lit(None).cast(t)
    heads = edits.select("*", F.lit(0).alias("kind"), none(turn).alias("turn"), none("string").alias("r0"), none("string").alias("t0"), F.lit(0).alias("copy"), none("string").alias("role"), none("string").alias("text"))
    measures = [f.name for f in schema.fields[1:]]
    turns = rows.where("NOT gone").select("c", *(none(schema[m].dataType).alias(m) for m in measures), F.lit(1).alias("kind"), "turn", "r0", "t0", "copy", "role", "text")
    full = _schema(conv, T.StructField("repaired_sha256", T.StringType()))
    both = _in_order(heads.unionByName(turns), "kind").select("c", *measures, "kind", "role", "text")
    return both.mapInArrow(_hashes(_arrow(full)), full).withColumnRenamed("c", "conv_id")


def repair_damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The contract's damage, then ``repair_conversations``; other columns don't matter."""
    return repair_conversations(damaged(df, conv_col, turn_col, role_col, text_col))
