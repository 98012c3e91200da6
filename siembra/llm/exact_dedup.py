"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every input partition hashes its texts (in the JVM) to ``20 + log2(rows)`` bits, sorts the
   hashes, cuts them into the ranges of the owners and sends each owner its range as a Golomb
   code (unary quotients of the gaps, then fixed-width remainders), each distinct hash once,
   with a bit for those that the sender has more than once.
2. An owner decodes what all partitions sent, finds the hashes that occur more than once and
   answers every sender with a bitmap over the hashes in the order they were sent.
3. Only rows whose bit is set are suspects. Their whole texts are grouped by the text itself -
   equality of bytes, combined on the map side, so a group with a third of all rows leaves one
   row per map task - and rows join their group by fingerprint and SHA-256.

What the rows carry through the exchange (id, fingerprint, SHA-256: some 50 bytes) is written
once to the shared folder, so a lost executor doesn't rerun the hashing and positions stay put.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bit_filter, bound_batches, materialise, may_hold, named, text_of

#: Rows of a partition that one message to an owner covers at most.
MESSAGE_ROWS = 1 << 20
#: Fingerprints that an owner gets on average, and the least number of owners.
OWNER_ROWS, LEAST_OWNERS = 50_000, 64
#: Groups above this share of all rows (1/HOT_SHARE) are joined by broadcast: less than HOT_SHARE rows of 60 bytes.
HOT_SHARE = 1000


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as a Golomb code: count, shift, unary quotients, remainders."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.array([0, 0], "<u8").tobytes()
    gaps = np.diff(values, prepend=np.uint64(0))
    shift = max(0, int(math.log2(max(1.0, float(values[-1]) / n))))
    ones = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places[None, :]) & np.uint64(1)).astype(np.uint8)
    return np.array([n, shift], "<u8").tobytes() + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    """The integers of ``golomb_encode``."""
    n, shift = (int(x) for x in np.frombuffer(code, "<u8", 2))
    if not n:
        return np.zeros(0, np.uint64)
    rest_bytes = (n * shift + 7) // 8
    body = np.frombuffer(code, np.uint8, offset=16)
    ones = np.flatnonzero(np.unpackbits(body[: len(body) - rest_bytes]))
    quotients = np.diff(ones, prepend=-1) - 1
    rest = np.unpackbits(body[len(body) - rest_bytes :])[: n * shift].reshape(n, shift)
    gaps = quotients.astype(np.uint64) << np.uint64(shift)
    for k in range(shift):
        gaps += rest[:, k].astype(np.uint64) << np.uint64(shift - 1 - k)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(batches: Iterator[pa.RecordBatch], owner_shift: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Messages of one partition to every owner, with the ids and digests in the order sent."""

    def messages(rows: pa.Table, part: int) -> pa.RecordBatch:
        prints = rows["print"].to_numpy().astype(np.uint64)
        order = np.argsort(prints, kind="stable")
        prints, owners = prints[order], (prints[order] >> np.uint64(owner_shift)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        ends = np.append(cuts[1:], len(owners))
        base = owners[cuts].astype(np.uint64) << np.uint64(owner_shift)
        # each distinct fingerprint goes out once, with a bit for those that repeat here already
        fresh = np.append(True, prints[1:] != prints[:-1])
        codes, again, runs = [], [], []
        for a, b, x in zip(cuts, ends, base, strict=True):
            begins = np.flatnonzero(fresh[a:b])
            codes.append(golomb_encode(prints[a:b][begins] - x))
            again.append(np.packbits(np.diff(begins, append=b - a) > 1).tobytes())
            runs.append(np.packbits(fresh[a:b]).tobytes())
        offsets = pa.array(np.append(cuts, len(owners)), pa.int32())
        spread = lambda name: pa.ListArray.from_arrays(offsets, rows[name].combine_chunks().take(pa.array(order)))
        columns = [pa.array(owners[cuts]), pa.array(np.full(len(cuts), part, np.int64)), *(pa.array(x, pa.binary()) for x in (codes, again, runs)), spread("id"), spread("digest")]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held, n, sender, message = [], 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            sender = batch.column("part")[0].as_py()
            held.append(batch)
            n += batch.num_rows
        if n >= MESSAGE_ROWS:
            yield messages(pa.Table.from_batches(held), (sender << 24) + message)
            held, n, message = [], 0, message + 1
    if held:
        yield messages(pa.Table.from_batches(held), (sender << 24) + message)


def _answer(table: pa.Table) -> pa.Table:
    """For one owner: a bitmap for every sender, set where a hash occurs more than once in all.

    A sender names a hash once, so a text in a third of all rows costs its owner one code a sender.
    """
    sent = [golomb_decode(x.as_py()) for x in table["code"]]
    again = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(p)].astype(bool) for x, p in zip(table["again"], sent, strict=True)]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    twice = np.union1d(values[counts > 1], np.concatenate([p[x] for p, x in zip(sent, again, strict=True)]))
    return pa.table({"owner": table["owner"], "sender": table["sender"], "bitmap": pa.array([np.packbits(np.isin(x, twice)).tobytes() for x in sent], pa.binary())})


def _read_answers(batches: Iterator[pa.RecordBatch], owner_shift: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows again, with what the owner's bitmap says of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            owner, sender = row.column("owner")[0].as_py(), row.column("sender")[0].as_py()
            prints = golomb_decode(row.column("code")[0].as_py()) + np.uint64(owner << owner_shift)
            bits = np.unpackbits(np.frombuffer(row.column("bitmap")[0].as_py(), np.uint8))[: len(prints)].astype(bool)
            ids, digests = row.column("id").flatten(), row.column("digest").flatten()
            run = np.cumsum(np.unpackbits(np.frombuffer(row.column("runs")[0].as_py(), np.uint8))[: len(ids)].astype(np.int64)) - 1
            prints, bits = prints[run], bits[run]
            columns = [ids, pa.array(prints.astype(np.int64)), digests, pa.array(bits), pa.array(np.full(len(prints), sender)), pa.array(np.arange(len(prints)) + (owner << 32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of byte-identical texts; one row per input row.

    Columns: the id, ``keep_id`` (the largest id of the group), ``group_size`` (long),
    ``kept`` (boolean) and ``text_sha256`` (lowercase hex). Other columns of ``df`` aren't read.

    Null texts count as empty, and all empty texts are one group. Null ids sort below all
    others: a row without an id is kept only if no row of its group has one. Of repeated rows
    (same id, same text) exactly one is kept. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    spark = df.sparkSession
    rows = df.count()
    bits = min(62, 20 + max(1, rows).bit_length())
    owner_bits = max(LEAST_OWNERS.bit_length() - 1, (rows // OWNER_ROWS).bit_length())
    owner_shift = bits - owner_bits
    id_type = df.schema[id_col].dataType
    hashed = lambda text: F.expr(f"shiftrightunsigned(xxhash64({text}), {64 - bits})")

    texts = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sent_schema = T.StructType([T.StructField("owner", T.LongType()), T.StructField("sender", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("again", T.BinaryType()), T.StructField("runs", T.BinaryType()), T.StructField("id", T.ArrayType(id_type)), T.StructField("digest", T.ArrayType(T.BinaryType()))])
    arrow_sent = _arrow(sent_schema)
    messages = materialise(
        texts.select("id", hashed("text").alias("print"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(lambda it: _send(it, owner_shift, arrow_sent), sent_schema),
        "exact-dedup",
    )
    answers = messages.select("owner", "sender", "code", "again").groupBy("owner").applyInArrow(_answer, "owner long, sender long, bitmap binary")
    flagged_schema = T.StructType([T.StructField("id", id_type), T.StructField("print", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("suspect", T.BooleanType()), T.StructField("sender", T.LongType()), T.StructField("place", T.LongType())])
    arrow_flagged = _arrow(flagged_schema)
    flagged = materialise(messages.join(answers, ["owner", "sender"]).mapInArrow(lambda it: _read_answers(it, owner_shift, arrow_flagged), flagged_schema), "exact-dedup-rows")

    suspects = flagged.where("suspect")
    bitset = bit_filter(suspects.select("print"), "print")
    verified = (
        texts.withColumn("print", hashed("text"))
        .where(may_hold(bitset, F.col("print")))
        .groupBy("text")
        .agg(F.max("print").alias("print"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("print", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "group_size")
    )
    best = suspects.groupBy("print", "digest").agg(F.max(F.struct("id", "sender", "place")).alias("best"))
    groups = best.join(verified, ["print", "digest"])
    groups = groups.withColumnsRenamed({"print": "group_print", "digest": "group_digest"})
    # Groups of more than 1/HOT_SHARE of all rows are less than HOT_SHARE: their many rows stay where they are.
    groups = materialise(groups, "exact-dedup-groups")
    hot, rest = groups.where(F.col("group_size") * HOT_SHARE > rows), groups.where(F.col("group_size") * HOT_SHARE <= rows)
    same = F.col("suspect") & (F.col("print") == F.col("group_print")) & (F.col("digest") == F.col("group_digest"))
    in_hot = flagged.join(F.broadcast(hot), same)
    others = flagged.join(F.broadcast(hot), same, "left_anti").join(rest, same, "left")
    paired = in_hot.unionByName(others)
    alone = F.col("best").isNull()
    return paired.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("sender") == F.col("best.sender")) & (F.col("place") == F.col("best.place")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with their columns.

    Rows without an id can't be told apart by it: of those with the same text one stays,
    and none beside a row with an id and that text. An empty table stays empty. Columns whose
    name begins with ``__`` are reserved; others may have any name.
    """
    found = materialise(exact_dedup(df, id_col, text_col).where("group_size > 1"), "exact-dedup-copies")
    # ids whose rows all go; an id with a kept row and a dropped one repeats whole rows
    fate = found.groupBy(F.col(id_col).alias("__fate_id"), F.col("text_sha256").alias("__fate_digest")).agg(F.max("kept").alias("__any_kept"), F.min("kept").alias("__all_kept")).where("not __all_kept")
    fate = materialise(fate, "exact-dedup-fate")
    # most rows have no fate and stay where they are; only the others' texts are shuffled
    listed = may_hold(bit_filter(fate.select("__fate_id"), "__fate_id"), named(id_col))
    joined = df.where(listed).withColumn("__digest", F.sha2(text_of(text_col), 256)).join(fate, named(id_col).eqNullSafe(F.col("__fate_id")) & (F.col("__digest") == F.col("__fate_digest")), "left")
    once = df.where(~listed).unionByName(joined.where("__any_kept is null").select(*map(named, df.columns)))
    if fate.where("__any_kept").isEmpty():
        return once
    again = joined.where("__any_kept").dropDuplicates([id_col, "__digest"]).select(*map(named, df.columns))
    return once.unionByName(again)
