"""SentencePiece encoding and decoding by a forward pass over shared prefixes.

A text is marked (a space before it, every space as the mark) and cut into words where no piece
of the vocabulary can span: before a mark that follows another character, and around line ends.
Words keep the space where the model has the mark: strings without the mark take half the memory.
The distinct words of an Arrow chunk that aren't known yet are sorted, which walks their trie
depth first: the forward states of the prefix shared with the word before stay, the rest is
extended character by character along the trie of pieces. Encoded words are remembered by the
Python worker up to ``REMEMBERED`` words.

The forward state depends on the kind of model:

* unigram: the best score of the prefix and its last piece - Viterbi;
* BPE: scores of a BPE model are merge ranks, whose sum doesn't rank segmentations, so adding
  them up alone can't give the model's own ids. Pairs of neighbours are therefore restricted (a
  forbidden pair scores minus infinity): a piece may follow another if merging both strings gives
  just these two pieces again. The forward score is the best over the pieces that may end at a
  place, of which there is one at most. That gives the ids of the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bound_batches, chunks, give_back, text_of

MARK = "▁"
#: Words that a Python worker remembers, and the longest one of them.
REMEMBERED, LONGEST = 500_000, 64
#: Pairs of neighbouring pieces that a Python worker remembers.
PAIRS = 500_000
#: Bytes of text whose new words are sorted together.
CHUNK = 1 << 20
_WORDS = re.compile("\n+| *[^ \n]+| +")
_UNIGRAM, _BPE, _NORMAL, _USER, _BYTE = 1, 2, 1, 4, 6


class Vocabulary:
    """Pieces of a model file, as plain values that can be sent to the workers."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only unigram and BPE models with the identity normaliser and a dummy prefix")
        self.bpe = proto.trainer_spec.model_type == _BPE
        self.size = len(proto.pieces)
        self.ids, self.scores, self.bytes = {}, {}, [-1] * 256
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.text: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            raw = b""
            if p.type == _BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                raw = bytes([int(p.piece[3:5], 16)])
            elif p.type in (_NORMAL, _USER):
                self.ids[p.piece] = i
                self.scores[i] = p.score
                raw = p.piece.replace(MARK, " ").encode()
            elif i == self.unknown:
                raw = b" \xe2\x81\x87 "
            self.text.append(raw)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece spans words")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(Path(path).read_bytes())


class Encoder:
    """Words to pieces, with the states of the last word's prefixes kept for the next."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.strings = {i: p for p, i in vocabulary.ids.items()}
        self.penalty = min(vocabulary.scores.values(), default=0.0) - 10
        self.follows: dict[int, bool] = {}  # by left piece * size + right piece
        self.packed = np.zeros(0, np.int64), np.zeros(0, bool)
        self.root: dict = {}
        for piece, i in vocabulary.ids.items():
            if " " in piece or vocabulary.bpe and len(piece) > 1 and self.merge(piece) != [i]:
                continue  # no marked text has it, or no sequence of merges makes it
            node = self.root
            for c in piece.replace(MARK, " "):
                node = node.setdefault(c, {})
            node[""] = i

    def merge(self, text: str) -> list[int]:
        """BPE of a short string by its definition: the best ranked adjacent pair first, leftmost of equals."""
        parts, ids, scores = list(text), self.v.ids, self.v.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return [ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.follows) > PAIRS:
            self.follows.clear()
        known = self.follows[left * self.v.size + right] = self.merge(self.strings[left] + self.strings[right]) == [left, right]
        return known

    def pack(self) -> None:
        """Hold what pairs may do in arrays, between tasks."""
        self.packed = np.fromiter(self.follows, np.int64, len(self.follows)), np.fromiter(self.follows.values(), bool, len(self.follows))
        self.follows.clear()

    def unpack(self) -> None:
        keys, values = self.packed
        self.follows.update(zip(keys.tolist(), values.tolist(), strict=True))
        self.packed = np.zeros(0, np.int64), np.zeros(0, bool)

    def encode_sorted(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Pieces of every word; the words are sorted and distinct, so shared prefixes are met once."""
        step = self._step_bpe if self.v.bpe else self._step_unigram
        # by depth: last piece (-1: a character without one), its start, open pieces (start, node), score
        states: list[tuple] = [(-2, 0, [], 0.0)]
        before = ""
        for word in words:
            keep, most = 0, min(len(word), len(before))
            while keep < most and word[keep] == before[keep]:
                keep += 1
            del states[keep + 1 :]
            for i in range(keep, len(word)):
                states.append(step(word[i], i, states))
            before = word
            yield self._trace(word, states)

    def _step_bpe(self, c: str, i: int, states: list[tuple]) -> tuple:
        """The state after one more character: the best score over the pieces that may follow; a forbidden pair counts as minus infinity."""
        follows, size = self.follows, self.v.size
        going, piece, at, best = [], -1, i, None
        for j, node in states[i][2]:
            node = node.get(c)
            if node is not None:
                going.append((j, node))
                if best is None and "" in node:  # one piece at most may follow, so the first that may is the best
                    p, (left, _, _, score) = node[""], states[j]
                    if left < 0 or (follows[left * size + p] if left * size + p in follows else self.may_follow(left, p)):
                        piece, at, best = p, j, score + self.v.scores[p]
        node = self.root.get(c)
        if node is not None:
            going.append((i, node))
            if best is None and "" in node:
                p, (left, _, _, score) = node[""], states[i]
                if left < 0 or (follows[left * size + p] if left * size + p in follows else self.may_follow(left, p)):
                    piece, best = p, score + self.v.scores[p]
        return piece, at, going, states[i][3] + self.penalty if best is None else best

    def _step_unigram(self, c: str, i: int, states: list[tuple]) -> tuple:
        """The state after one more character: the best score, of equals the longest last piece."""
        going, piece, at, best = [], -1, i, None
        for j, node in [*states[i][2], (i, self.root)]:
            node = node.get(c)
            if node is not None:
                going.append((j, node))
                p = node.get("")
                if p is not None and (best is None or states[j][3] + self.v.scores[p] > best):
                    piece, at, best = p, j, states[j][3] + self.v.scores[p]
        return piece, at, going, states[i][3] + self.penalty if best is None else best

    def _trace(self, word: str, states: list[tuple]) -> list[int]:
        out, i = [], len(word)
        while i:
            piece, at = states[i][:2]
            if piece >= 0:
                out.append(piece)
            else:
                raw = [self.v.bytes[b] for b in word[at:i].replace(" ", MARK).encode()]
                out += raw[::-1] if min(raw) >= 0 else [self.v.unknown]
            i = at
        return out[::-1]


class Codec:
    """Texts to ids and back for whole Arrow chunks; lives as long as the Python worker."""

    _held: dict[int, Codec] = {}

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.encoder = Encoder(vocabulary)
        sizes = np.array([len(x) for x in vocabulary.text], np.int64)
        self.piece_size, self.piece_at = sizes, np.cumsum(sizes) - sizes
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.text), np.uint8)
        self.forget()

    @classmethod
    def of(cls, key: int, shared: Broadcast) -> Codec:
        """The worker's codec; the vocabulary is read from its broadcast only where there is none yet, for every copy read stays in memory."""
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(shared.value)
        return cls._held[key]

    def forget(self) -> None:
        """Drop the remembered words: a worker outlives its task, its memory shouldn't."""
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.count = array("i"), array("q"), array("q")

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Numbers of new words; long ones are numbered for this chunk only."""
        fresh = sorted(set(words))
        out = {}
        for word, ids in zip(fresh, self.encoder.encode_sorted(fresh), strict=True):
            out[word] = len(self.begin)
            self.begin.append(len(self.pool))
            self.count.append(len(ids))
            self.pool.extend(ids)
        self.known.update((w, k) for w, k in out.items() if len(w) <= LONGEST)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets."""
        if len(self.known) > REMEMBERED or len(self.pool) > 16 * REMEMBERED:
            self.forget()
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += _WORDS.findall(" " + text.replace(MARK, " "))
            ends.append(len(words))
        get = self.known.get
        numbers = [get(w, -1) for w in words]
        missing = [w for w, k in zip(words, numbers, strict=True) if k < 0]
        if missing:
            new = self._learn(missing)
            numbers = [k if k >= 0 else new[w] for w, k in zip(words, numbers, strict=True)]
        number = np.array(numbers, np.int64)
        count = np.frombuffer(self.count, np.int64)[number] if len(number) else np.zeros(0, np.int64)
        begin = np.frombuffer(self.begin, np.int64)[number] if len(number) else np.zeros(0, np.int64)
        where = np.concatenate([[0], np.cumsum(count)])
        ids = np.frombuffer(self.pool, np.int32)[np.repeat(begin - where[:-1], count) + np.arange(where[-1])] if where[-1] else np.zeros(0, np.int32)
        return ids.astype(np.int32), where[ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all texts with the space of the dummy prefix still before each, and its offsets."""
        size = self.piece_size[ids]
        where = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.repeat(self.piece_at[ids] - where[:-1], size) + np.arange(where[-1])] if where[-1] else np.zeros(0, np.uint8)
        return data, where[offsets]


def _same(data: np.ndarray, offsets: np.ndarray, decoded: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which decoded texts are the prefix's space and the bytes of the text."""
    size = np.diff(offsets)
    ok = np.diff(where) == np.where(size > 0, size + 1, 0)
    out = ok.copy()
    for k in np.flatnonzero(ok & (size > 0)):
        out[k] = np.array_equal(decoded[where[k] + 1 : where[k + 1]], data[offsets[k] : offsets[k + 1]])
    return out


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Piece ids of every whole text: the ``keep`` columns, ``ids`` (array of int), ``n_tokens`` and ``round_trip``.

    One row per input row. Null and empty texts have no pieces. ``round_trip`` tells whether
    decoding gives the text's bytes again; it doesn't only where the text holds the mark itself,
    which decodes to a space, or (in a model without bytes) an unknown character. Columns of
    ``keep`` that are named like a result column are replaced by it. Repeated rows are encoded
    alike; an empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in keep if c not in ("ids", "n_tokens", "round_trip")]
    vocabulary = Vocabulary.load(model_path)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # a model file: bounded by its number of pieces
    key = hash((model_path, vocabulary.size))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(key, shared)
        codec.encoder.unpack()
        for part, data, offsets in chunks(batches, "__text", CHUNK):
            ids, where = codec.encode(part.column("__text").to_pylist())
            decoded, at = codec.decode(ids, where)
            lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(np.diff(where)), pa.array(_same(data, offsets, decoded, at))], names=schema.names)
        part = data = offsets = ids = where = decoded = at = lists = None
        codec.forget()
        codec.encoder.pack()
        give_back()

    return df.select(*keep, text_of(text_col).alias("__text")).mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Texts of id arrays: the ``keep`` columns and ``text_col``. Null arrays give null, empty ones empty texts; an empty table an empty result."""
    bound_batches(df.sparkSession)
    keep = [c for c in keep if c != text_col]
    vocabulary = Vocabulary.load(model_path)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    key = hash((model_path, vocabulary.size))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(key, shared)
        for batch in batches:
            lists = batch.column("__ids")
            ids, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy()
            data, where = codec.decode(ids.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            texts = [None if null else raw[a:b].decode(errors="replace").removeprefix(" ") for a, b, null in zip(where[:-1], where[1:], lists.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
