"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. The index holds them by blocks of rows as slices: bit b
of component j of all rows of a block is one bitmap. A query's score is then a sum of slices
with weights: its components in signed binary digits say which slice counts with which power of
two, a negative digit takes the complement. Slices of one weight are added by full adders on
whole bitmaps, whose carries go to the next weight, so the scores come out as slices as well.
The k best rows are selected from the most significant slice downward, without any row's score
being formed. Slices of the lowest weights are left out of the addition; what they can add at most
is known, so the rows within that bound of the k-th best are the boundary rows, and those get their
exact score from all of their bits. Nothing is approximate in the result.

Each block meets each batch of queries once and gives at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siembra.llm.shared import bound_batches, discard, give_back, materialise, named

#: Components (rows x dimensions) of a block: 65,536 rows of 64 dimensions, some 6 MB of slices.
BLOCK = 1 << 22
#: Queries of a batch.
BATCH = 256
#: Tasks that blocks are dealt to by their hash: so many for each block, and at most that many in all.
SLOTS_A_BLOCK, MOST_SLOTS = 4, 4096
#: The slices left out may change a score by this part of the block's typical one at most.
TOLERANCE = 1 / 64
#: Quantised components are at most this large, so that every score fits a long.
LARGEST = 1 << 26

_INDEX = "rows int, dims int, low long, bits int, ids binary, nulls int, slices binary"


def quantise(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    """floor(scale * x) of each component; shorter vectors are filled up with zeros."""
    dims = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), dims), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = np.floor(scale * v.astype(np.float64))
    return out


def sliced(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(lowest value, bits, slices): slices[j, b] is the bitmap of bit b of ``values[:, j]`` above the lowest."""
    rows, dims = values.shape
    low = int(values.min()) if values.size else 0
    above = (values - low).T.astype(np.uint64)
    bits = max(1, int(above.max()).bit_length() if above.size else 1)
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((above >> np.uint64(b)).astype(np.uint8) & 1, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return low, bits, out.view(np.uint64)


def _digits(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, power, sign) of the signed binary digits of integers, no two of which are neighbours."""
    x = np.abs(value).astype(np.int64)
    plus, minus = (3 * x & ~x) >> 1, (x & ~(3 * x)) >> 1
    powers = np.arange(max(1, int(x.max()).bit_length() + 1))
    has_plus, has_minus = (plus[:, None] >> powers) & 1, (minus[:, None] >> powers) & 1
    j, c = np.nonzero(has_plus | has_minus)
    return j, c, np.where(has_plus[j, c] == 1, 1, -1) * np.sign(value[j])


def _left_out(powers: np.ndarray, bits: int, most: float) -> tuple[int, int]:
    """(lowest weight to add, what all lower slices can add up to) with that sum at most ``most``."""
    count = np.bincount(powers, minlength=int(powers.max()) + 1) if len(powers) else np.zeros(1, np.int64)
    at, dropped = 0, 0
    while True:
        here = int(sum(count[c] for c in range(max(0, at - bits + 1), min(len(count) - 1, at) + 1))) << at
        if dropped + here > most or at > len(count) + bits:
            return at, dropped
        at, dropped = at + 1, dropped + here


def add_slices(by_weight: dict[int, np.ndarray], first: int, words: int) -> list[np.ndarray]:
    """Slices, from weight ``first`` up, of the sum of bitmaps given by weight: full adders on stacks of bitmaps."""
    total, carried, at = [], [], first
    last = max(by_weight, default=first - 1)
    while at <= last or carried:
        stacks = [by_weight[at]] if at in by_weight else []
        stack = np.concatenate(stacks + carried) if stacks or carried else np.zeros((0, words), np.uint64)
        carried = []
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carry = a & b
                carry |= half & c
                half ^= c
                stack = np.concatenate([half, stack[3 * n :]])
            else:
                carry, stack = stack[:1] & stack[1:], stack[:1] ^ stack[1:]
            carried.append(carry)
        total.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        at += 1
    return total


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_best(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among ``rows`` (a bitmap of more than k), from the most significant slice downward."""
    equal, above, value = rows.copy(), 0, 0
    for b in range(len(slices) - 1, -1, -1):
        ones = equal & slices[b]
        n = _count(ones)
        if above + n >= k:
            equal, value = ones, value | 1 << b
        else:
            above, equal = above + n, equal & ~slices[b]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows whose value is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return np.zeros_like(rows)
    more, equal = np.zeros_like(rows), rows
    for b in range(len(slices) - 1, -1, -1):
        if value >> b & 1:
            equal = equal & slices[b]
        else:
            more, equal = more | equal & slices[b], equal & ~slices[b]
    return more | equal


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """One block of the index."""

    def __init__(self, rows: int, dims: int, low: int, bits: int, ids: np.ndarray, nulls: int, slices: np.ndarray):
        self.rows, self.dims, self.low, self.bits, self.ids, self.known = rows, dims, low, bits, ids, rows - nulls
        self.words = -(-rows // 64)
        plain = slices.reshape(dims, bits, self.words)
        self.both = np.stack([plain, ~plain])
        self.all = np.zeros(self.words * 64, np.uint8)
        self.all[:rows] = 1
        self.all = np.packbits(self.all, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact scores of rows, from all of their bits."""
        weights = (1 << np.arange(self.bits)).astype(np.int64)
        bits = (self.both[0][:, :, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
        return np.einsum("jbm,b,j->m", bits.astype(np.int64), weights, query) + self.low * int(query.sum())

    def best(self, vec_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows but the query's own, equal scores by place."""
        query = np.concatenate([query[: self.dims], np.zeros(max(0, self.dims - len(query)), np.int64)])
        rows = self.all.copy()
        own = slice(*np.searchsorted(self.ids[: self.known], [vec_id, vec_id + 1]))
        for place in range(own.start, own.stop):
            rows[place >> 6] &= ~np.uint64(1 << (place & 63))
        if _count(rows) > k and query.any():
            j, c, sign = _digits(query)
            first, dropped = _left_out(c, self.bits, TOLERANCE * (1 << self.bits) * float(np.linalg.norm(query)))
            flip = (sign < 0).astype(np.int64)
            by_weight = {}
            for at in range(first, int(c.max()) + self.bits):
                here = (c <= at) & (c > at - self.bits)
                if here.any():
                    by_weight[at] = self.both[flip[here], j[here], at - c[here]]
            sums = add_slices(by_weight, first, self.words)
            bound = kth_best(sums, rows, k) - -(-dropped // (1 << first))
            rows = at_least(sums, rows, bound)
        places = _places(rows)
        found = [self.scores(query, places[a : a + 4096]) for a in range(0, len(places), 4096)]
        scores = np.concatenate(found) if found else np.zeros(0, np.int64)
        order = np.lexsort((places, -scores))[:k]
        return places[order], scores[order]


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v) of the rows whose vector is whole: no null, no component that is null, not finite or beyond ``LARGEST``."""
    v = named(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST))
    return df.select(named(id_col).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & sound)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _index(scale: float):
    def block(ids: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0))
        low, bits, slices = sliced(quantise([vectors[r] for r in order], scale))
        known = np.array([0 if ids[r] is None else ids[r] for r in order], np.int64)
        return pa.RecordBatch.from_pydict({"rows": pa.array([len(ids)], pa.int32()), "dims": pa.array([slices.shape[0]], pa.int32()), "low": [low], "bits": pa.array([bits], pa.int32()), "ids": [known.tobytes()], "nulls": pa.array([sum(i is None for i in ids)], pa.int32()), "slices": [slices.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, dims = [], [], 1
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), _vectors(batch.column("v")), strict=True):
                if ids and (len(ids) + 1) * max(dims, len(v)) > BLOCK:
                    yield block(ids, vectors)
                    ids, vectors, dims = [], [], 1
                dims = max(dims, len(v))
                ids.append(i)
                vectors.append(v)
        if ids:
            yield block(ids, vectors)
        give_back()

    return run


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The index of all usable vectors, written to the shared folder: blocks of slices, rows sorted by id.

    Each partition of the input makes its own blocks, so nothing is shuffled; ``discard`` deletes the table.
    """
    bound_batches(df.sparkSession)
    return materialise(_usable(df, id_col, vector_col, scale).mapInArrow(_index(scale), _INDEX), "slices")


def _batches(scale: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), _vectors(batch.column("v"))
            for a in range(0, len(ids), size):
                values = quantise(vectors[a : a + size], scale)
                yield pa.RecordBatch.from_pydict({"asked": [np.array(ids[a : a + size], np.int64).tobytes()], "width": pa.array([values.shape[1]], pa.int32()), "queries": [values.tobytes()]})

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                block = Block(row["rows"], row["dims"], row["low"], row["bits"], ids, row["nulls"], np.frombuffer(row["slices"], np.uint64))
                asked = np.frombuffer(row["asked"], np.int64)
                values = np.frombuffer(row["queries"], np.int64).reshape(len(asked), row["width"])
                found = [block.best(int(q), v, k) for q, v in zip(asked, values, strict=True)]
                places = np.concatenate([p for p, _ in found])
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(asked, [len(p) for p, _ in found]),
                    "vec_id": pa.array(ids[places], mask=places >= block.known),
                    "score": np.concatenate([s for _, s in found]),
                })
        give_back()

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of the index but its own, equal scores by smaller vec_id.

    Repeated rows of the index are rows of their own; rows without an id can be found, after those with one of the
    same score. Of several rows of a query's id the least vector asks; a query without an id or without a usable vector has no
    rows. Vectors of different lengths are compared as if filled up with zeros. Blocks are dealt into slots, as many as the
    count of blocks asks for, and a batch of queries goes to each; a slot keeps k rows a query.
    """
    bound_batches(index.sparkSession)
    slots = max(1, min(SLOTS_A_BLOCK * index.count(), MOST_SLOTS))
    asked = _usable(queries, id_col, vector_col, scale).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    batches = asked.mapInArrow(_batches(scale, BATCH), "asked binary, width int, queries binary")
    batches = batches.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).repartition(slots, "slot")
    blocks = index.withColumn("slot", F.pmod(F.xxhash64("slices", "ids"), F.lit(slots)).cast("int")).repartition(slots, "slot")
    found = blocks.join(batches, "slot").drop("slot").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, step: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k best of all rows for each row whose id is divisible by ``step``.

    An empty table gives no rows. Columns of other names don't matter. The result is written, and the index deleted.
    """
    index = build_index(df, id_col, vector_col, scale)
    out = materialise(search(index, df.where(named(id_col) % step == 0), k, id_col, vector_col, scale), "top")
    discard(index)
    return out
