"""Document fingerprints from improbable features.

Every window of 32 bytes has an entropy. How often an entropy occurs in the whole corpus ranks
it: the rarer, the lower the rank. In each run of 32 neighbouring windows the leftmost window of
the lowest rank scores a point; windows with ``POPULAR`` points are the features of a text, or those with
the most points where none has as many.
Their hashes go, five bits each, into Bloom filters of 2048 bits, a new filter being chained on
after 160 features. Two digests are compared filter by filter: common bits beyond what chance
gives, over the most they could have in common.

Windows are found for a whole Arrow chunk at once in integer arithmetic, so equal texts have
equal fingerprints whatever stands beside them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bound_batches, chunks, materialise, named, text_of
from siembra.llm.textkit import mix

WINDOW, POPULAR = 32, 8
FILTER_BITS, FILTER_FEATURES, BITS_PER_FEATURE = 2048, 160, 5
#: Share of the way from chance to the greatest overlap that counts as no likeness.
#: It is at least as many standard deviations of chance, which matters for filters of few bits.
CUT, SPREADS = 0.1, 2.5
BINS = 1001
CHUNK = 1 << 19
_SCALE = 1 << 20
_XLOGX = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_XLOGX)
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Entropy of every window of ``data``, in BINS steps; one less than WINDOW shorter than the data."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[: n - d] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _XLOGX[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    whole = int(_XLOGX[WINDOW])
    return (whole - total) * (BINS - 1) // whole


def _ends(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(offsets[1:], np.diff(offsets))


def histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Windows by entropy bin, without those that span two texts."""
    bins = entropy_bins(data)
    inside = _ends(offsets)[: len(bins)] - np.arange(len(bins)) >= WINDOW
    return np.bincount(bins[inside], minlength=BINS)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of every bin: 0 for the rarest; ties by bin."""
    ranks = np.empty(BINS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BINS)
    return ranks


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every feature, by text and place; each hash once a text.

    A text below WINDOW bytes is one feature, an empty one has none; any other has at least one.
    """
    size = np.diff(offsets)
    docs, hashes, places = [], [], []
    bins = entropy_bins(data)
    if len(bins):
        at = np.arange(len(bins))
        ends = _ends(offsets)[: len(bins)]
        left = ends - at
        key = np.where(left >= WINDOW, (ranks[bins] << 32) | at, np.int64(1) << 62)
        least = key
        for width in (1, 2, 4, 8, 16):
            if len(least) > width:
                least = np.minimum(least[:-width], least[width:])
        runs = np.flatnonzero(left[: len(least)] >= 2 * WINDOW - 1) if len(bins) >= WINDOW else np.zeros(0, np.int64)
        points = np.bincount(least[runs] & 0xFFFFFFFF, minlength=len(bins))
        scored = np.flatnonzero(points)
        owner = np.searchsorted(offsets, scored, "right") - 1
        top = np.zeros(len(size), np.int64)
        np.maximum.at(top, owner, points[scored])
        chosen = scored[points[scored] >= np.minimum(top[owner], POPULAR)]
        few = np.flatnonzero((size >= WINDOW) & (size < 2 * WINDOW - 1))
        lone = np.array([key[offsets[k] : offsets[k + 1] - WINDOW + 1].min() & 0xFFFFFFFF for k in few], np.int64)
        pos = np.sort(np.concatenate([chosen, lone]))
        raw = np.ascontiguousarray(data[pos[:, None] + np.arange(WINDOW)]).view("<u8")
        h = np.zeros(len(pos), np.uint64)
        for k in range(WINDOW // 8):
            h = mix(h ^ raw[:, k]) + np.uint64(k)
        docs.append(np.searchsorted(offsets, pos, "right") - 1)
        hashes.append(h)
        places.append(pos)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    if len(short):
        docs.append(short)
        hashes.append(np.array([int.from_bytes(hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=8).digest(), "little") for k in short], np.uint64))
        places.append(offsets[short])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, h, place = np.concatenate(docs), np.concatenate(hashes), np.concatenate(places)
    if not len(doc):
        return doc, h
    order = np.lexsort((place, h, doc))
    fresh = np.append(True, (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]))
    kept = order[fresh]
    kept = kept[np.argsort(place[kept], kind="stable")]
    return doc[kept], h[kept]


class Digests:
    """Filters of many texts: bytes (filters x 256) and the offsets of each text's filters."""

    def __init__(self, bits: np.ndarray, offsets: np.ndarray) -> None:
        self.bits, self.offsets = bits, offsets
        self.size = _POPCOUNT[bits].sum(1, dtype=np.int64)

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> Digests:
        doc, h = features(data, offsets, ranks)
        n = len(offsets) - 1
        counts = np.bincount(doc, minlength=n)
        filters = -(-counts // FILTER_FEATURES)
        where = np.concatenate([[0], np.cumsum(filters)])
        first = np.cumsum(counts) - counts
        number = where[doc] + (np.arange(len(doc)) - first[doc]) // FILTER_FEATURES
        bits = np.zeros(where[-1] * FILTER_BITS, bool)
        for k in range(BITS_PER_FEATURE):
            bits[number * FILTER_BITS + ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        return cls(np.packbits(bits).reshape(-1, FILTER_BITS // 8), where)

    @classmethod
    def of_texts(cls, texts: list[str], ranks: np.ndarray) -> Digests:
        """Of a list of texts, in chunks."""
        parts = [cls.of(d, o, ranks) for _, d, o in chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), "text", CHUNK)]
        return cls.join(parts)

    @classmethod
    def join(cls, parts: list[Digests]) -> Digests:
        counts = np.concatenate([np.diff(p.offsets) for p in parts]) if parts else np.zeros(0, np.int64)
        return cls(np.concatenate([p.bits for p in parts]) if parts else np.zeros((0, FILTER_BITS // 8), np.uint8), np.concatenate([[0], np.cumsum(counts)]))

    def take(self, rows: slice) -> Digests:
        where = self.offsets[rows.start : rows.stop + 1]
        return Digests(self.bits[where[0] : where[-1]], where - where[0])

    def packed(self) -> list[bytes]:
        """The bytes of the filters of each text."""
        return [self.bits[a:b].tobytes() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]

    def strings(self) -> list[str]:
        """``count:base64`` of the filters of each text."""
        return [f"{b - a}:{base64.b64encode(self.bits[a:b].tobytes()).decode()}" for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]


def parse_digest(text: str) -> np.ndarray:
    """Filters of a fingerprint string."""
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def _overlap(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits beyond the cut-off, over the most that were possible."""
    most = np.minimum(a, b)
    chance = a * b / FILTER_BITS
    spread = np.sqrt(chance * (1 - np.maximum(a, b) / FILTER_BITS))
    cut = np.minimum(chance + np.maximum(CUT * (most - chance), SPREADS * spread), most - 1)
    return np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0.0, 1.0)


def likeness(left: Digests, right: Digests) -> np.ndarray:
    """Likeness 0 to 1 of each text of ``left`` with the same place in ``right``.

    Every filter of the digest with fewer filters counts with its best match in the other, by
    its bits. Two empty digests are alike, an empty one and another aren't.
    """
    n = len(left.offsets) - 1
    na, nb = np.diff(left.offsets), np.diff(right.offsets)
    out = ((na == 0) & (nb == 0)).astype(np.float64)
    one = np.flatnonzero((na == 1) & (nb == 1))
    a, b = left.offsets[:-1][one], right.offsets[:-1][one]
    out[one] = _overlap(_POPCOUNT[left.bits[a] & right.bits[b]].sum(1, dtype=np.int64), left.size[a], right.size[b])
    for k in np.flatnonzero((na > 0) & (nb > 0) & (na + nb > 2)):
        x, y = slice(left.offsets[k], left.offsets[k + 1]), slice(right.offsets[k], right.offsets[k + 1])
        bits, sizes, other, other_sizes = (left.bits[x], left.size[x], right.bits[y], right.size[y]) if na[k] <= nb[k] else (right.bits[y], right.size[y], left.bits[x], left.size[x])
        best = np.array([_overlap(_POPCOUNT[row & other].sum(1, dtype=np.int64), size, other_sizes).max() for row, size in zip(bits, sizes, strict=True)])
        out[k] = (best * sizes).sum() / sizes.sum()
    return out[:n]


def corpus_ranks(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropies by how rare they are in all texts (BINS numbers)."""
    bound_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for _, data, offsets in chunks(batches, "text", CHUNK):
            total += histogram(data, offsets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bin": full, "n": total[full]})

    found = df.select(text_of(text_col).alias("text")).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for row in found:
        counts[row["bin"]] = row["n"]
    return ranks_of(counts)


def digest_texts(df: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text: the id and ``fingerprint``.

    Null counts as empty, and an empty text has a fingerprint without filters. Repeated rows have
    equal fingerprints; an empty table gives an empty result. Other columns aren't read.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "__text", CHUNK):
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(Digests.of(data, offsets, ranks).strings(), pa.string())], names=schema.names)

    return df.select(id_col, text_of(text_col).alias("__text")).mapInArrow(run, schema)


def _edited(texts: list[str], following: list[str]) -> list[str]:
    """The last floor(n/2) code points of each text replaced by the first as many, or all, of the one that follows."""
    return [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, following, strict=True)]


def _compared(ids: pa.Array, texts: list[str], following: list[str], this: Digests, after: Digests, ranks: np.ndarray) -> dict[str, pa.Array]:
    """The result columns, in bytes, of texts, the texts that follow them and both digests."""
    edited = _edited(texts, following)
    other = Digests.of_texts(edited, ranks)
    return {
        "id": ids, "n_chars": pa.array([len(x) for x in texts], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(x.encode()).digest() for x in edited], pa.binary()),
        "fingerprint": pa.array(this.packed(), pa.binary()), "edited_fingerprint": pa.array(other.packed(), pa.binary()), "near_edited": pa.array(likeness(this, other)), "near_next": pa.array(likeness(this, after)),
    }


def compare_with_next(df: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside an edited one and the next document's, in descending order of ids.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all)
    of the next document; after the last comes the first. One row per input row: the id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``. Null texts count as empty. Rows without an id come after the others; equal ids
    go by text hash, and repeated rows follow each other. A single row is its own next, and an empty
    table gives an empty result. Other columns aren't read.

    Texts are shuffled once, by ranges of (id, text hash, row), so an id may repeat in any number of rows.
    Every range writes what it can compare and its own first and last row; the last row of a
    range then meets the first of the next one that has rows, by a join of two rows a range.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    base = df.select(named(id_col).alias("id"), text_of(text_col).alias("text")).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("id"), F.desc("hash"), F.asc("row")]
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part"))
    result = T.StructType([T.StructField("id", kind), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    schema = T.StructType([*result, T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape, shape_of_result = to_arrow_schema(schema), to_arrow_schema(result)

    def shaped(columns: dict[str, pa.Array], to: pa.Schema) -> pa.RecordBatch:
        n = len(columns["id"])
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in to], schema=to)

    def edge(row: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        return shaped({"id": row.column("id"), "part": row.column("part"), "last": pa.array([last]), "text": row.column("text")}, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_text, held_digest = None, "", None
        for part, data, offsets in chunks(batches, "text", CHUNK):
            texts, digest, ids = part.column("text").to_pylist(), Digests.of(data, offsets, ranks), part.column("id")
            if held is None:
                yield edge(part.slice(0, 1), False)
            else:
                texts, digest, ids = [held_text, *texts], Digests.join([held_digest, digest]), pa.concat_arrays([held.column("id"), ids])
            n = len(texts)
            held, held_text, held_digest = part.slice(part.num_rows - 1, 1), texts[-1], digest.take(slice(n - 1, n))
            if n > 1:
                yield shaped(_compared(ids.slice(0, n - 1), texts[:-1], texts[1:], digest.take(slice(0, n - 1)), digest.take(slice(1, n)), ranks), shape)
        if held is not None:
            yield edge(held, True)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches, "text", CHUNK):
            texts, following = part.column("text").to_pylist(), part.column("following").to_pylist()
            yield shaped(_compared(part.column("id"), texts, following, Digests.of_texts(texts, ranks), Digests.of_texts(following, ranks), ranks), shape_of_result)

    written = materialise(dealt.mapInArrow(run, schema), "digests", compression="zstd")
    first, last = written.where("not last").select("part", F.col("text").alias("following")), written.where("last").select("id", "part", "text")
    # two numbers a range, in one task: the next range that has rows, and after the last one the first
    by_part = Window.orderBy("part")
    turn = last.select("part").withColumn("next", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)))
    ends = last.join(turn, "part").join(first.withColumnRenamed("part", "next"), "next").select("id", "text", "following").mapInArrow(close, result)
    both = written.where("last is null").select(*result.names).unionByName(ends)
    shown = lambda c: F.concat((F.octet_length(c) / (FILTER_BITS // 8)).cast("int").cast("string"), F.lit(":"), F.translate(F.base64(c), "\r\n", "")).alias(c)
    return both.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
