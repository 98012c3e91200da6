"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept where a seed of ``SEED`` words has the least hash of ``SPAN`` neighbouring
seeds (minimisers): content selects them, so a passage brings its suffixes along wherever it
stands, and each run of SEED + SPAN - 1 = 39 words holds at least one.

1. The seeds of all texts are counted (combined before the shuffle); a bit filter of bounded
   size keeps those of one document only from going further.
2. What may repeat is sorted by its words: seed, then the ``RIGHT`` words from there on, as range
   partitions. A passage in a third of all documents is spread over as many partitions as its
   suffixes need, since id and place are part of the order.
   A second copy is sorted by seed and the ``LEFT`` words before it, so that passages that agree further
   to the left meet although others with the same seed agree with them further to the right.
3. Neighbours in both orders are compared: words in common to the right and, from the ``LEFT``
   words carried along, to the left. Both ends of every partition are compared once more
   with those of the next, a few rows for each partition.
4. A match of ``min_words`` or more is a span in both texts; spans of a text that overlap are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bit_filter, bound_batches, chunks, materialise, may_hold, text_of
from siembra.llm.textkit import shingles, span_hashes, word_bounds

SEED, SPAN, LEFT, RIGHT = 8, 32, 40, 64
MIN_WORDS = 50
#: 64-bit words of the filter of repeated seeds: 4 MB.
FILTER_WORDS = 1 << 19


def minimisers(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, word place in the chunk and hash of every kept seed; all word hashes and each text's words."""
    first, last, words = word_bounds(data, offsets)
    hashes = span_hashes(data, first, last)
    seeds, where = shingles(hashes, words, SEED)
    counts = np.diff(words)
    none = np.zeros(0, np.int64)
    if len(seeds) < SPAN:
        return none, none, np.zeros(0, np.uint64), hashes, words
    low = np.uint64((1 << 24) - 1)
    key = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    for width in (1, 2, 4, 8, 16):
        key = np.minimum(key[:-width], key[width:])
    doc = np.repeat(np.arange(len(counts)), np.diff(where))
    at = np.arange(len(key))
    whole = (doc[: len(key)] == doc[SPAN - 1 :]) & (counts[doc[: len(key)]] >= min_words)
    kept = np.unique((key[at[whole]] & low).astype(np.int64))
    owner = doc[kept]
    return owner, words[:-1][owner] + kept - where[:-1][owner], seeds[kept], hashes, words


def _context(hashes: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit names of the words before each place (nearest first) and from it on; 0 beyond the text."""
    names = np.maximum((hashes >> np.uint64(48)).astype(np.uint16), 1)

    def gather(at: np.ndarray) -> np.ndarray:
        inside = (at >= low[:, None]) & (at < high[:, None])
        return np.where(inside, names[np.clip(at, 0, len(names) - 1)], np.uint16(0))

    return gather(place[:, None] - 1 - np.arange(LEFT)), gather(place[:, None] + np.arange(RIGHT))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in common from the start, row by row; beyond a text nothing is."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, width)


class _Neighbours:
    """Compares sorted suffixes in batches; the last runs of a batch wait for the next one."""

    def __init__(self, min_words: int) -> None:
        self.min_words = min_words

    def spans(self, table: pa.Table) -> pa.Table:
        """Spans in both texts for neighbouring suffixes of different documents."""
        seed, doc = table["seed"].to_numpy(), table["doc"].to_numpy()
        n = len(seed)
        run = np.cumsum(np.append(0, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])))
        begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        end = np.append(begin[1:], n) - 1
        i = np.arange(n)
        pairs = [(i[run >= k], end[run[run >= k] - k]) for k in (1, 2)] + [(i[run < run[-1]], begin[run[run < run[-1]] + 1])]
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        use = (seed[a] == seed[b]) & (doc[a] != doc[b])
        a, b = a[use], b[use]
        left, right = _fixed(table["left"], LEFT), _fixed(table["right"], RIGHT)
        l, r = _common(left[a], left[b]), _common(right[a], right[b])
        hit = l + r >= self.min_words
        a, b, l, r = a[hit], b[hit], l[hit], r[hit]
        place, ids = table["place"].to_numpy(), table["id"].combine_chunks()
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        l, r = np.concatenate([l, l]), np.concatenate([r, r])
        return pa.table({"doc": doc[x], "id": ids.take(pa.array(x)), "start": place[x] - l, "stop": place[x] + r, "match": ids.take(pa.array(y))})


def _edges(table: pa.Table, from_end: bool) -> pa.Table:
    """Rows of the first or last three runs of the same seed and document."""
    seed, doc = table["seed"].to_numpy(), table["doc"].to_numpy()
    run = np.cumsum(np.append(0, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])))
    rows = np.flatnonzero(run >= run[-1] - 2) if from_end else np.flatnonzero(run <= 2)
    ends = np.unique([f(rows[run[rows] == k]) for k in np.unique(run[rows]) for f in (np.min, np.max)])
    return table.take(pa.array(ends))


def _compare(batches: Iterator[pa.RecordBatch], min_words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Spans of one sorted partition, and the rows at its two ends."""
    look = _Neighbours(min_words)
    held: pa.Table | None = None
    begun: pa.Table | None = None

    def shaped(part: pa.Table, edge: bool) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        columns = [(part[f.name].combine_chunks() if f.name in part.column_names else pa.nulls(n, f.type)) if f.name != "edge" else pa.array([edge] * n) for f in schema]
        if n:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if begun is None or begun.num_rows < 6:
            begun = _edges(pa.concat_tables([begun, table]) if begun is not None else table, False)
        if held is not None:
            table = pa.concat_tables([held, table])
        yield from shaped(look.spans(table), False)
        held = _edges(table, True)
    if held is not None:
        yield from shaped(begun, True)
        yield from shaped(held, True)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` words that another document has too.

    One row per merged span: the id, ``start_word`` and ``end_word`` (exclusive; words are runs of
    bytes above the space, from 0), ``n_words`` and ``match_id``, the smallest id met among the
    documents that share it. Two rows are different documents unless id and text are equal;
    A-Z count as a-z. Null, empty and short texts have no spans, and an empty table gives an
    empty result. ``min_words`` is at least SEED + SPAN - 1. Other columns aren't read.
    """
    bound_batches(df.sparkSession)
    if min_words < SEED + SPAN - 1:
        raise ValueError(f"min_words must be {SEED + SPAN - 1} or more")
    kind = df.schema[id_col].dataType
    texts = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("doc", F.xxhash64("id", "text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            owner, _, seed, _, _ = minimisers(data, offsets, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int64)), part.column("doc").take(pa.array(owner))], names=["seed", "doc"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text", 1 << 20):
            owner, place, seed, hashes, words = minimisers(data, offsets, min_words)
            if not len(owner):
                continue
            low = words[:-1][owner]
            left, right = _context(hashes, place, low, words[1:][owner])
            rows = pa.array(owner)
            # big-endian, so that the order of the bytes is the order of the words
            packed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 2), len(x), [None, pa.py_buffer(np.ascontiguousarray(x.astype(">u2")).tobytes())]).cast(pa.binary()) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int64)), packed[1], packed[0], part.column("doc").take(rows), part.column("id").take(rows), pa.array(place - low)], names=["seed", "right", "left", "doc", "id", "place"])

    counted = texts.select("doc", "text").mapInArrow(seeds, "seed long, doc long").groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b")
    bits = bit_filter(counted.select("seed"), "seed", FILTER_WORDS)
    suffix_schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("right", T.BinaryType()), T.StructField("left", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("id", kind), T.StructField("place", T.LongType())])
    maybe = texts.mapInArrow(suffixes, suffix_schema).where(may_hold(bits, F.col("seed"), FILTER_WORDS))
    orders = (["seed", "right", "doc", "place"], ["seed", "left", "right", "doc", "place"])
    out = T.StructType([*suffix_schema, T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("match", kind), T.StructField("edge", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(out)
    run = lambda it: _compare(it, min_words, shape)
    kept = materialise(maybe, "passages-suffixes")
    found = []
    for order in orders:
        compared = materialise(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, out), "passages-spans")
        # a few rows for each partition, whatever the input
        ends = compared.where("edge").select(*suffix_schema.names).coalesce(1).sortWithinPartitions(*order).mapInArrow(run, out)
        found.append(compared.unionByName(ends))
    spans = found[0].unionByName(found[1]).where("not edge").groupBy("doc", "id", "start", "stop").agg(F.min("match").alias("match"))
    by_start = Window.partitionBy("doc", "id").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("island", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy("doc", "id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("match").alias("match_id"))
    return merged.select(F.col("id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "match_id")
