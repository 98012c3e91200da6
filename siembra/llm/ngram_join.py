"""N-gram Jaccard join by chosen paths.

1. Every text becomes its set of ``size``-word shingles and a sketch: for each of ``COORDS``
   hash functions the shingle with the least hash. Texts with the same set are one class.
2. Chosen paths: a bucket of classes (at first all) is split by a few of its coordinates, drawn
   with probability BRANCHES / COORDS each; classes that share the sampled shingle go
   to the same child. Small buckets are compared by brute force on the sketches. A larger one
   is first linked to a pivot. Rows far from the pivot go on to the children; a row near it goes on
   only if some row far from the pivot may be similar to it, as the nearest of those tells (distances obey
   the triangle inequality). So a bucket of copies ends at its pivot, whatever its size, and
   one of texts that only share a line is split further. Runs repeat until a pair at the threshold is met with
   probability ``recall``: a pair survives ever deeper splits with a probability that stays above
   a floor, for it shares more than one drawn shingle of a bucket on average.
3. Candidates are closed to components, and each component's whole texts are compared exactly
   (all pairs, as one matrix product in tiles of ``TILE``), so a path that misses one of many
   links inside a component loses nothing.

Only edges to a root and sums per class leave a task, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.components import connected_components, stars
from siembra.llm.shared import bit_filter, bound_batches, chunks, materialise, may_hold, named, text_of
from siembra.llm.textkit import mix, shingles, span_hashes, word_bounds

COORDS = 64
#: Classes of a bucket that are compared directly; a larger bucket is split. Comparing a row with so many
#: others takes about 140 microseconds, not much longer than writing, shuffling and joining its rows for the child buckets.
BUCKET = 4096
#: Coordinates that a bucket is split by on average.
BRANCHES = 2.0
#: Splits of a bucket at most; then tiles of LAST rows are compared with each other.
MAX_DEPTH, LAST = 8, 4096
#: Estimated similarity that links a row of a large bucket to its pivot. Links only close
#: candidates to components, which are compared exactly, so it may lie below the threshold.
PIVOT = 0.5
#: Estimates may be off by so much where a row is left out by the triangle inequality.
SLACK = 0.15
TILE = 256
#: Pairs of sketches compared at once, and the size from which a bucket is compared block by block.
PAIRS, BLOCKED = 1 << 15, 128
_SEEDS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(7919))
_TOKEN_BITS = np.uint64(20)  # tokens are the upper 44 bits, so that a sort key also holds the text


def token_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle tokens of every text in ascending order, and their offsets."""
    first, last, words = word_bounds(data, offsets)
    hashes, where = shingles(span_hashes(data, first, last), words, size)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(where))
    keys = hashes >> _TOKEN_BITS
    if len(offsets) - 1 < 1 << 20:
        keys = np.sort((doc << np.uint64(44)) | keys)
        fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        keys = keys[fresh]
        doc, keys = keys >> np.uint64(44), keys & np.uint64((1 << 44) - 1)
    else:
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))
        keys, doc = keys[fresh], doc[fresh]
    return keys, np.searchsorted(doc, np.arange(len(offsets), dtype=np.uint64))


def sketches(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x COORDS) 32-bit names of the least-hashed token by coordinate; 0 for an empty set."""
    out = np.zeros((len(offsets) - 1, COORDS), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        base = mix(tokens)
        for k in range(COORDS):
            least = np.minimum.reduceat((base ^ _SEEDS[k]) * (_SEEDS[k] | np.uint64(1)), offsets[:-1][full])
            out[full, k] = mix(least) >> np.uint64(32)
    return out


def set_keys(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of every set: equal sets have equal keys. Two of n sets share one by chance with n^2 / 2^65."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(1)), dtype=np.uint64)])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + mix(np.diff(offsets).astype(np.uint64))).astype(np.int64)


def survival(similarity: float, depth: int) -> float:
    """Chance that one run keeps a pair at the threshold together for ``depth`` splits."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - p * similarity * BRANCHES / COORDS) ** COORDS
    return p


def runs_for(recall: float, similarity: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def _drawn(nodes: np.ndarray) -> np.ndarray:
    """(nodes x COORDS): the coordinates that a node splits on; at least one."""
    draw = mix(nodes[:, None] ^ _SEEDS[None, :]) >> np.uint64(11)
    chosen = draw < np.uint64((1 << 53) * BRANCHES / COORDS)
    chosen[np.arange(len(nodes)), draw.argmin(1)] = True
    return chosen


def _children(nodes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child buckets of rows (node, sketch)."""
    row, coord = np.nonzero(_drawn(nodes))
    return row, mix(nodes[row] ^ mix((sketch[row, coord].astype(np.uint64) << np.uint64(8)) | coord.astype(np.uint64))).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches, cut so that no key's rows are in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left")) if (keys[:-1] <= keys[1:]).all() else 0
        if held and cut == 0 and keys[-1] == held[-1].column(key)[-1].as_py():
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        done = pa.Table.from_batches([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else None
        if done is not None:
            yield done
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


class _Links:
    """Pairs of row numbers, contracted to stars whenever HELD of them have gathered."""

    HELD = 1 << 18

    def __init__(self) -> None:
        self.left, self.right, self.n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)
        self.n += len(left)
        if self.n > self.HELD:
            left, right = self.stars()
            self.left, self.right, self.n = [left], [right], 0

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        return stars(np.concatenate(self.left), np.concatenate(self.right))


def _near_pairs(sketch: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that agree on ``need`` coordinates at least by the low bytes of their names, block by block.

    Low bytes agree wherever names do, and by chance on one of 256 other coordinates, so no pair is lost.
    """
    low = np.ascontiguousarray(sketch.astype(np.uint8))
    at = 0
    while at < len(low):
        to = at + max(1, PAIRS // (len(low) - at))
        equal = (low[at:to, None, :] == low[None, at:, :]).view(np.uint64)
        left, right = np.nonzero(np.triu(np.bitwise_count(equal).sum(2, dtype=np.uint8) >= need, 1))
        yield at + left, at + right
        at = to


def _brute(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Star edges of small buckets between classes whose sketches agree on ``least`` of the coordinates."""
    need = math.ceil(least * COORDS)
    for table in _whole_groups(batches, "bucket"):
        bucket, cls = table["bucket"].to_numpy(), table["cls"].to_numpy()
        sketch = _matrix(table["sketch"].combine_chunks())
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        links = _Links()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > BLOCKED:
                for left, right in _near_pairs(sketch[a:b], need):
                    links.add(a + left, a + right)
        size = np.diff(cuts)
        small = np.repeat(size <= BLOCKED, size)
        end = np.repeat(cuts[1:], size)
        later = np.where(small, end - np.arange(len(bucket)) - 1, 0)
        at = 0
        while at < len(bucket):  # rows at..to have at most PAIRS pairs, or the pairs of one row
            to = max(at + 1, int(np.searchsorted(np.cumsum(later[at : at + PAIRS]), PAIRS, "right")) + at)
            left = np.repeat(np.arange(at, to), later[at:to])
            first = np.cumsum(later[at:to]) - later[at:to]
            right = left + 1 + np.arange(len(left)) - np.repeat(first, later[at:to])
            near = (sketch[left] == sketch[right]).sum(1) >= need
            links.add(left[near], right[near])
            at = to
        left, right = links.stars()
        u, v = stars(cls[left], cls[right])
        if len(u):
            yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def _judge(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets with the coordinates they share with their pivot; near ones hang on it from now on."""
    for batch in batches:
        if batch.num_rows:
            cls, pivot = batch.column("cls").to_numpy(), batch.column("pivot").to_numpy()
            agree = (_matrix(batch.column("sketch")) == _matrix(batch.column("pivot_sketch"))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("cls"), pa.array(np.where(agree >= need, pivot, cls)), pa.array(agree.astype(np.int32)), batch.column("sketch")], names=["bucket", "cls", "held", "agree", "sketch"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each child bucket."""
    for batch in batches:
        if batch.num_rows:
            row, child = _children(batch.column("bucket").to_numpy().astype(np.uint64), _matrix(batch.column("sketch")))
            yield pa.RecordBatch.from_pydict({"bucket": child, "cls": batch.column("cls").to_numpy()[row], "held": batch.column("held").to_numpy()[row]})


def jaccard_matrix(tokens: np.ndarray, offsets: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Exact Jaccard similarity of all pairs of sets (of ``rows`` with all, if given)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    sorted_, owner = tokens[order], owner[order]
    name = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    shared = np.bincount(name)[name] > 1 if len(name) else np.zeros(0, bool)
    name, owner = name[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // max(1, n))
    if len(name):
        name = np.cumsum(np.append(0, name[1:] != name[:-1]))
        for low in range(0, int(name[-1]) + 1, step):
            a, b = np.searchsorted(name, [low, low + step])
            m = np.zeros((n, min(step, int(name[-1]) + 1 - low)), np.float32)
            m[owner[a:b], name[a:b] - low] = 1
            common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def _verify(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Exact links of every tile: sums per class, and an edge from each linked class to its root."""
    for table in _whole_groups(batches, "tile"):
        tile = table["tile"].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
        cls, side, copies = table["cls"].to_numpy(), table["side"].to_numpy(), table["copies"].to_numpy()
        texts = table["text"].combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            _, unique = np.unique(cls[a:b], return_index=True)
            pick = unique + a
            if len(pick) < 2:
                continue
            parts = [token_sets(d, o, size) for _, d, o in chunks(iter([pa.RecordBatch.from_pydict({"text": texts.take(pa.array(pick))})]))]
            tokens = np.concatenate([t for t, _ in parts])
            sizes = np.concatenate([np.diff(o) for _, o in parts])
            near = jaccard_matrix(tokens, np.concatenate([[0], np.cumsum(sizes)])) >= similarity - 1e-6
            # In a tile of two groups the pairs inside one group belong to that group's own tile.
            groups = side[pick]
            near &= groups[:, None] != groups[None, :] if len(np.unique(groups)) > 1 else ~np.eye(len(pick), dtype=bool)
            left, right = np.nonzero(np.triu(near, 1))
            if not len(left):
                continue
            c = cls[pick]
            u, v = stars(c[left], c[right])
            hit = np.flatnonzero(near.any(1))
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v), "cls": pa.nulls(len(u), pa.int64()), "links": pa.nulls(len(u), pa.int64())})
            yield pa.RecordBatch.from_pydict({"u": none, "v": none, "cls": pa.array(c[hit]), "links": pa.array((near[hit] @ copies[pick]).astype(np.int64))})


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """Near-duplicate classes: documents linked by a Jaccard similarity of word shingles >= ``similarity``.

    One row per input row: the id, ``class_id`` (smallest id of the linked documents; null if
    none has one), ``class_size`` (documents in the class), ``n_links`` (other documents at or
    above the threshold, copies included) and ``n_shingles``. Other columns aren't read.

    A text of fewer than ``size`` words has one shingle of all its words. Null, empty and
    wordless texts link to nothing and are classes of their own. Repeated rows are copies.
    An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    least = similarity - 3 * math.sqrt(similarity * (1 - similarity) / COORDS)
    id_type = df.schema[id_col].dataType
    texts = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            tokens, where = token_sets(data, offsets, size)
            rows = [x.tobytes() for x in sketches(tokens, where)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(set_keys(tokens, where)), pa.array(np.diff(where)), pa.array(rows, pa.binary())], names=["id", "text_hash", "cls", "n", "sketch"])

    row_schema = T.StructType([T.StructField("id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    rows = materialise(texts.mapInArrow(sketch, row_schema), "near-rows")
    # equal sets have equal sketches, so any of them stands for the class
    classes = materialise(rows.where("n > 0").groupBy("cls", "sketch").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.min("text_hash").alias("text_hash")), "near-classes")

    edges = _paths(classes, runs_for(recall, similarity, MAX_DEPTH), similarity, least)
    candidates = connected_components(reduce(DataFrame.unionByName, edges))

    # Exact comparison of whole texts, component by component, in tiles.
    sized = candidates.join(candidates.groupBy("label").agg(F.count("*").alias("m")), "label").withColumn("groups", F.ceil(F.col("m") / TILE).cast("int"))
    side = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda k: F.struct(F.least("side", k).alias("a"), F.greatest("side", k).alias("b"))))
    tiles = sized.withColumn("side", side).withColumn("pair", pairs).select(F.col("node").alias("cls"), "side", F.xxhash64("label", "pair.a", "pair.b").alias("tile"))
    members = materialise(candidates.select(F.col("node").alias("cls")).join(classes.select("cls", "copies", "text_hash"), "cls"), "near-members")
    bits = bit_filter(members.select("text_hash"), "text_hash")
    whole = texts.where(may_hold(bits, F.col("text_hash"))).select("text").distinct().withColumn("text_hash", F.xxhash64("text")).join(members, "text_hash")
    exact = (
        whole.join(tiles, "cls").select("tile", "cls", "side", "copies", "text").repartition(F.col("tile")).sortWithinPartitions("tile")
        .mapInArrow(lambda it: _verify(it, size, similarity), "u long, v long, cls long, links long")
    )
    exact = materialise(exact, "near-links")
    groups = connected_components(exact.where("u is not null").select("u", "v")).withColumnRenamed("node", "cls")
    links = exact.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    told = groups.join(classes.select("cls", "copies", "least_id"), "cls").join(links, "cls", "left")
    whole_class = told.groupBy("label").agg(F.min("least_id").alias("group_id"), F.sum("copies").alias("group_size"))
    linked = materialise(told.join(whole_class, "label").select("cls", "group_id", "group_size", "links"), "near-told")
    info = classes.select("cls", "copies", "least_id").join(linked, "cls", "left").select("cls", F.coalesce("group_id", "least_id").alias("class_id"), F.coalesce("group_size", "copies").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # a class with many copies puts many rows on one key; adaptive execution splits that side
    worded = rows.where("n > 0").select("id", "cls", "n").join(info, "cls", "left").select("id", "class_id", "class_size", "n_links", "n")
    wordless = rows.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), "n")
    return worded.unionByName(wordless).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", F.col("n").alias("n_shingles"))


def _paths(classes: DataFrame, runs: int, similarity: float, least: float) -> list[DataFrame]:
    """Candidate edges of all runs. Rows are narrow (bucket, class) until their bucket is known to be worth a sketch."""
    roots = mix(np.arange(runs, dtype=np.uint64) + np.uint64(1000))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sketch = batch.column("cls").to_numpy(), _matrix(batch.column("sketch")) if batch.num_rows else np.zeros((0, COORDS), np.uint32)
            for node in roots:
                row, child = _children(np.full(len(cls), node), sketch)
                yield pa.RecordBatch.from_pydict({"bucket": child, "cls": cls[row], "held": cls[row]})

    known = classes.select("cls", "sketch")
    brute = lambda df: df.join(known, "cls").select("bucket", "cls", "sketch").repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lambda it: _brute(it, least), "u long, v long")
    frontier = materialise(known.mapInArrow(begin, "bucket long, cls long, held long"), "near-buckets")
    edges = []
    for depth in range(1, MAX_DEPTH + 1):
        # the pivot is drawn anew for every bucket; a bucket that hangs on one row already is done
        sizes = frontier.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by("cls", F.xxhash64("bucket", "cls")).alias("pivot"), F.min("held").alias("low"), F.max("held").alias("high")).where("size > 1 and low <> high")
        met = materialise(frontier.select("bucket", "cls").join(sizes.select("bucket", "size", "pivot"), "bucket"), "near-met")
        edges.append(brute(met.where(F.col("size") <= BUCKET)))
        large = met.where(F.col("size") > BUCKET)
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            parts = F.ceil(F.col("size") / LAST).cast("int")
            tiled = large.withColumn("part", F.pmod(F.xxhash64("cls"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            edges.append(brute(tiled.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "cls")))
            break
        # one pivot for a bucket of more than BUCKET rows: few beside the rows
        pivots = large.select("bucket", "pivot").distinct().join(known.select(F.col("cls").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot").select("bucket", "pivot", "pivot_sketch")
        both = large.select("bucket", "cls").join(known, "cls").join(pivots, "bucket").select("bucket", "cls", "sketch", "pivot", "pivot_sketch")
        need = math.ceil(min(least, PIVOT) * COORDS)
        judged = materialise(both.mapInArrow(lambda it, n=need: _judge(it, n), "bucket long, cls long, held long, agree int, sketch binary"), "near-judged")
        edges.append(judged.where(f"agree >= {need} and cls <> held").select(F.col("cls").alias("u"), F.col("held").alias("v")))
        # the row nearest to the pivot among those that don't hang on it says which of the others may be similar to one of them
        nearest = judged.where(F.col("agree") < need).groupBy("bucket").agg(F.max("agree").alias("nearest"))
        reach = (1 - similarity + SLACK) * COORDS
        onward = judged.join(nearest, "bucket").where((F.col("agree") < need) | (F.col("agree") <= F.col("nearest") + reach))
        frontier = materialise(onward.select("bucket", "cls", "held", "sketch").mapInArrow(_split, "bucket long, cls long, held long"), "near-buckets")
    return edges


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when every class keeps the row with its smallest id.

    Rows without an id stay: they can't be named as the ones to drop. An empty table stays empty,
    and repeated rows (same id) stay or go together. A column ``__drop`` is reserved.
    """
    found = near_classes(df, id_col, text_col, **options)
    drop = materialise(found.where((F.col("class_size") > 1) & (F.col(id_col) != F.col("class_id"))).select(F.col(id_col).alias("__drop")).distinct(), "near-drop")
    return df.join(drop, named(id_col) == F.col("__drop"), "left_anti")
