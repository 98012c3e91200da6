"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of every document is
encoded (byte classes, word shapes, repetition, hash classes of words), lifted by a learned layer, and weighted by
gated attention: weight ~ exp(w . (tanh(V h) * sigmoid(U h))). The weighted passage
representation gives the score. Only document labels train it; which passages matter is learned.

Fitting uses a bounded sample: the ``max_train`` labelled rows with the smallest hash of their
id, on the driver in numpy. Scoring reads every whole text, in Arrow chunks, and keeps one
chunk in memory. Label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bound_batches, chunks, text_of
from siembra.llm.textkit import segment_sums, span_hashes, word_bounds

PASSAGE_WORDS = 64
#: Labelled rows that fit the model at most; all their passages count.
MAX_TRAIN = 4000
#: Bytes of text whose passages are encoded at once.
CHUNK = 1 << 18
THRESHOLD = 0.3
HIDDEN, ATTENTION = 24, 12

#: Byte classes: lower, upper, digit, space, line end, each of ". , ! ? |", other ASCII signs, the rest.
_CLASS = np.full(256, 11, np.uint8)
_CLASS[33:127] = 10
for _low, _high, _k in ((97, 123, 0), (65, 91, 1), (48, 58, 2), (0, 33, 3), (10, 11, 4)):
    _CLASS[_low:_high] = _k
for _k, _c in enumerate(b".,!?|", 5):
    _CLASS[_c] = _k
#: Hash classes of words: the share of each in a passage.
LEXICAL = 32
N_FEATURES = 12 + 8 + LEXICAL


class Passages(NamedTuple):
    """Features (passages x N_FEATURES) and the offsets of each document's passages."""

    features: np.ndarray
    offsets: np.ndarray


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> Passages:
    """Every passage of every text; a text without words has one passage of zeros but for its size."""
    first, last, words = word_bounds(data, offsets)
    counts = np.diff(words)
    made = np.maximum(1, -(-counts // PASSAGE_WORDS))
    out = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(counts)), made)
    start = words[:-1][doc] + (np.arange(out[-1]) - out[:-1][doc]) * PASSAGE_WORDS
    stop = np.minimum(start + PASSAGE_WORDS, words[1:][doc])
    bounds = np.append(start, words[-1])
    # bytes of a passage: from its first word to the next passage's first word or the text's end
    at = np.concatenate([first, [len(data)]])
    ends_doc = np.append(doc[1:] != doc[:-1], True)
    byte_from = np.where(start < words[1:][doc], at[np.minimum(start, len(first))], offsets[1:][doc])
    byte_to = np.where(ends_doc, offsets[1:][doc], at[np.minimum(stop, len(first))])
    n = np.maximum(stop - start, 1).astype(np.float64)

    x = np.zeros((out[-1], N_FEATURES), np.float32)
    classes = _CLASS[data]
    # bytes before a text's first word count with its first passage
    edges = np.where(np.append(True, doc[1:] != doc[:-1]), offsets[:-1][doc], byte_from)
    size = np.maximum(byte_to - edges, 1).astype(np.float64)
    cell = np.repeat(np.arange(out[-1], dtype=np.int32) * 12, byte_to - edges) + classes
    x[:, :12] = np.bincount(cell, minlength=12 * out[-1]).reshape(-1, 12) / size[:, None]
    if len(first):
        hashes = span_hashes(data, first, last)
        passage = np.repeat(np.arange(out[-1]), stop - start)
        keys = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = np.append(True, keys[1:] != keys[:-1])
        x[:, 12] = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=out[-1]) / n
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1]))
        x[:, 13] = segment_sums(same, bounds) / n
        ended, began = classes[last - 1], classes[first]
        x[:, 14] = segment_sums(ended >= 5, bounds) / n
        x[:, 15] = segment_sums(ended == 10, bounds) / n
        x[:, 16] = segment_sums(began == 1, bounds) / n
        x[:, 17] = segment_sums(last - first, bounds) / n / 10
        x[:, 20:] = np.bincount(passage * LEXICAL + (hashes >> np.uint64(59)).astype(np.int64), minlength=LEXICAL * out[-1]).reshape(-1, LEXICAL) / n[:, None]
    x[:, 18] = np.log1p(stop - start) / 5
    x[:, 19] = (np.log1p(counts) / 10)[doc]
    return Passages(x, out)


class Model(NamedTuple):
    """Standardisation, the lifted layer (w, b), the gate (v, u, a) and the output (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(m: Model, bags: Passages) -> dict[str, np.ndarray]:
    x = np.clip((bags.features - m.mean) / m.scale, -6, 6)
    h = np.tanh(x @ m.w + m.b)
    tv, su = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    e = (tv * su) @ m.a
    doc = np.repeat(np.arange(len(bags.offsets) - 1), np.diff(bags.offsets))
    e = np.exp(e - np.maximum.reduceat(e, bags.offsets[:-1])[doc])
    weight = e / np.add.reduceat(e, bags.offsets[:-1])[doc]
    z = np.add.reduceat(h * weight[:, None], bags.offsets[:-1], axis=0)
    return {"x": x, "h": h, "tv": tv, "su": su, "weight": weight, "z": z, "doc": doc, "score": _sigmoid(z @ m.c + m.d)}


def score(m: Model | None, bags: Passages) -> np.ndarray:
    """Score of every bag, 0 to 1; 0.5 without a model (no labels to learn from)."""
    return np.full(len(bags.offsets) - 1, 0.5) if m is None else _forward(m, bags)["score"].astype(np.float64)


def fit(bags: Passages, labels: np.ndarray, steps: int = 150, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the mean log loss; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    x = bags.features.astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    prior = np.clip(labels.mean(), 0.01, 0.99)
    p = [draw(N_FEATURES, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION), draw(HIDDEN) * 0.1, np.array(np.log(prior / (1 - prior)))]
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    for step in range(1, steps + 1):
        m = Model(mean, scale, *p)
        f = _forward(m, bags)
        err = (f["score"] - labels) / len(labels)
        dz = err[:, None] * m.c
        by_passage = dz[f["doc"]]
        gain = (by_passage * f["h"]).sum(1)
        mean_gain = np.add.reduceat(gain * f["weight"], bags.offsets[:-1])
        de = f["weight"] * (gain - mean_gain[f["doc"]])
        dgate = de[:, None] * m.a
        dv, du = dgate * f["su"] * (1 - f["tv"] ** 2), dgate * f["tv"] * f["su"] * (1 - f["su"])
        dh = (by_passage * f["weight"][:, None] + dv @ m.v.T + du @ m.u.T) * (1 - f["h"] ** 2)
        grads = [f["x"].T @ dh, dh.sum(0), f["h"].T @ dv, f["h"].T @ du, (f["tv"] * f["su"]).T @ de, f["z"].T @ err, np.array(err.sum())]
        for k, g in enumerate(grads):
            g = g + decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), *(np.asarray(v, np.float32) for v in p))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that never train: crc32 of the id as text divides by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model | None:
    """Fit on at most ``max_train`` labelled rows that aren't held out; None without any.

    Null labels and ids don't count; of several labels of one id the smallest does, and of several
    texts the first in order. Empty tables give no model.
    """
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("key")).agg(F.min(F.col(label_col)).cast("double").alias("label")).orderBy(F.xxhash64("key"), "key").limit(max_train)
    rows = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, limit=CHUNK):
            bags = encode_passages(data, offsets)
            cut = [bags.features[a:b].tobytes() for a, b in zip(bags.offsets[:-1], bags.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"order": part.column("order"), "label": part.column("label"), "features": pa.array(cut, pa.binary())})

    found = rows.select(F.xxhash64("key", "text").alias("order"), "label", "text").mapInArrow(encode, "order long, label double, features binary").toPandas().sort_values("order")
    if not len(found):
        return None
    parts = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in found["features"]]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return fit(Passages(np.concatenate(parts), offsets), found["label"].to_numpy())


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score of every whole text: the id, ``held_out``, ``score`` and ``predicted``; one row per input row.

    Null and empty texts are one passage without words and get the model's score for that.
    Repeated rows score alike; an empty table gives an empty result. Other columns of ``docs`` aren't read.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, limit=CHUNK):
            value = score(model, encode_passages(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with all their columns and no shuffle.

    Null and empty texts are scored as texts without words; repeated rows stay or go together.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the text column itself is read, so that no second copy of the texts goes to the worker
            texts = batch.column(at).cast(pa.string()).fill_null("")
            good = [score(model, encode_passages(data, offsets)) >= threshold for _, data, offsets in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), limit=CHUNK)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    at = docs.columns.index(text_col)
    places = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names may hold dots
    return places.mapInArrow(run, places.schema).toDF(*docs.columns)
