"""Clashing and dotted column names, filler words, hot fingerprints, gradients and a twin of the digests."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from siembra.llm import exact_dedup as ED
from siembra.llm import feature_digest as FD
from siembra.llm import license_scan as LS
from siembra.llm import ngram_join as NJ
from siembra.llm import quality_classifier as QC
from siembra.llm import repeated_passages as RP
from siembra.llm import sentencepiece_codec as SC
from siembra.llm import source_mix as SM

NAMES = ["w", "p_key", "o_key", "o_range", "w_key", "p_j", "p_w", "any_kept", "all_kept", "fate_id", "fate_digest", "a.b", "hash", "part", "last", "row", "next", "following", "id", "cls", "held", "seed", "left", "right", "doc", "place", "key", "order", "label", "ids", "n_tokens", "bucket"]


@pytest.fixture
def odd(docs):
    return docs.withColumn("source", F.when(F.col("doc_id") > 3, "x")).withColumns({c: F.lit("clash") for c in NAMES})


def test_any_column_name_goes(odd, spark):
    n = odd.count()
    assert SM.mix_sources(odd).count() == n
    mixed = SM.mixed(odd, block_size=1)
    assert mixed.columns == odd.columns and mixed.count() == n
    kept = ED.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    near = NJ.drop_near_copies(odd)
    assert near.columns == odd.columns and near.count() == 9
    assert ED.exact_dedup(odd).count() == n
    assert QC.keep_quality(odd, None).count() == n
    assert FD.compare_with_next(odd, FD.corpus_ranks(odd)).count() == n
    assert RP.repeated_passages(odd).count() >= 0
    assert LS.scan_licenses(odd).count() == 0
    assert SC.encode_pieces(odd, "/opt/tokenizers/piece_bpe_32k.model").count() == n


def test_words_between_the_words_of_a_license(spark):
    words = LS.TEMPLATES["MIT"].split()
    filled = " ".join(f"{w} filler{k} other{k} more{k}" for k, w in enumerate(words))
    apart = " ".join(f"{w} " + " ".join(f"f{k}x{j}" for j in range(9)) for k, w in enumerate(words))
    df = spark.createDataFrame([(1, filled), (2, apart), (3, LS.TEMPLATES["MIT"])], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["coverage"] for r in LS.scan_licenses(df).collect()}
    assert got.get((1, "MIT")) == 1 and got.get((3, "MIT")) == 1 and (2, "MIT") not in got
    wide = {(r["doc_id"], r["license"]) for r in LS.scan_licenses(df, spread=10.0).collect()}
    assert (2, "MIT") in wide


def test_a_text_in_most_rows_costs_its_owner_one_code(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id") % 4000)).alias("text")).repartition(4)
    rows = ED.exact_dedup(df).groupBy("text_sha256").agg(F.count("*").alias("n"), F.min("group_size").alias("a"), F.max("group_size").alias("b"), F.sum(F.col("kept").cast("int")).alias("k"), F.max("doc_id").alias("top"), F.min("keep_id").alias("keep")).collect()
    assert len(rows) == 1001 and all(r["n"] == r["a"] == r["b"] and r["k"] == 1 and r["top"] == r["keep"] for r in rows)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    bags = QC.Passages(rng.normal(size=(12, QC.N_FEATURES)).astype(np.float32), np.array([0, 3, 4, 9, 12]))
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    first = QC.fit(bags, labels, steps=1, rate=0.0, decay=0.0)

    def loss(m):
        s = QC._forward(m, bags)["score"]
        return float(-(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean())

    wide = QC.Model(*(np.asarray(v, np.float64) for v in first))
    moved = QC.fit(bags, labels, steps=1, rate=1e-3, decay=0.0)
    for name in ("w", "v", "u", "a", "c"):  # Adam's first step goes against the sign of each partial derivative
        step = np.asarray(getattr(moved, name), np.float64) - getattr(wide, name)
        for at in [np.unravel_index(k, step.shape) for k in range(0, step.size, max(1, step.size // 7))]:
            up, down = (wide._replace(**{name: getattr(wide, name) + d * (np.arange(step.size).reshape(step.shape) == np.ravel_multi_index(at, step.shape))}) for d in (1e-4, -1e-4))
            slope = (loss(up) - loss(down)) / 2e-4
            if abs(slope) > 1e-6:
                assert np.sign(step[at]) == -np.sign(slope)


def _entropy_bin(window: bytes) -> int:
    whole = int(FD._XLOGX[FD.WINDOW])
    return (whole - sum(int(FD._XLOGX[window.count(c)]) for c in set(window))) * (FD.BINS - 1) // whole


def _twin_filters(text: str, ranks: np.ndarray) -> list[set[int]]:
    """Set bits of each filter of a text, one window after another."""
    data = text.encode()
    n = len(data) - FD.WINDOW + 1
    if n < 1:
        return None
    key = [(int(ranks[_entropy_bin(data[k : k + FD.WINDOW])]), k) for k in range(n)]
    points = [0] * n
    for k in range(n - FD.WINDOW + 1):
        points[min(key[k : k + FD.WINDOW])[1]] += 1
    need = min(max(points), FD.POPULAR)
    chosen = [k for k in range(n) if points[k] and points[k] >= need] if any(points) else [min(key)[1]]
    hashes = []
    for k in chosen:
        h = np.zeros(1, np.uint64)
        for j, x in enumerate(np.frombuffer(data[k : k + FD.WINDOW], "<u8")):
            h = FD.mix(h ^ x) + np.uint64(j)
        if int(h[0]) not in hashes:
            hashes.append(int(h[0]))
    groups = [hashes[k : k + FD.FILTER_FEATURES] for k in range(0, len(hashes), FD.FILTER_FEATURES)]
    return [{(h >> (11 * k)) & (FD.FILTER_BITS - 1) for h in g for k in range(FD.BITS_PER_FEATURE)} for g in groups]


def _twin_likeness(x: list[set[int]], y: list[set[int]]) -> float:
    """Each filter of the digest with fewer filters by its best match, weighted by its bits."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)

    def overlap(a: set[int], b: set[int]) -> float:
        most, chance = min(len(a), len(b)), len(a) * len(b) / FD.FILTER_BITS
        spread = (chance * (1 - max(len(a), len(b)) / FD.FILTER_BITS)) ** 0.5
        cut = min(chance + max(FD.CUT * (most - chance), FD.SPREADS * spread), most - 1)
        return min(1.0, max(0.0, (len(a & b) - cut) / max(most - cut, 1e-9)))

    return sum(max(overlap(a, b) for b in many) * len(a) for a in few) / sum(map(len, few))


def test_digests_equal_their_twin(spark):
    rng = np.random.default_rng(4)
    words = [f"{chr(97 + k % 26)}{chr(97 + k * 7 % 26)}{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, size)) for size in (12, 13, 20, 60, 300, 900, 2500, 61)]
    texts.append(texts[4] + " and a little more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ranks = FD.corpus_ranks(df)
    counts = np.zeros(FD.BINS, np.int64)
    for t in texts:
        data = t.encode()
        for k in range(len(data) - FD.WINDOW + 1):
            counts[_entropy_bin(data[k : k + FD.WINDOW])] += 1
    assert list(ranks) == [sorted(range(FD.BINS), key=lambda b: (counts[b], b)).index(b) for b in range(FD.BINS)]
    got = {r["doc_id"]: r for r in FD.compare_with_next(df, ranks).collect()}
    twins = [_twin_filters(t, ranks) for t in texts]
    for k, filters in enumerate(twins):
        raw = np.unpackbits(np.frombuffer(base64.b64decode(got[k]["fingerprint"].partition(":")[2]), np.uint8)).reshape(-1, FD.FILTER_BITS)
        assert [set(np.flatnonzero(r).tolist()) for r in raw] == filters
        assert got[k]["near_next"] == pytest.approx(_twin_likeness(filters, twins[k - 1]))
        edited = FD._edited([texts[k]], [texts[k - 1]])[0]
        assert got[k]["near_edited"] == pytest.approx(_twin_likeness(filters, _twin_filters(edited, ranks)))


def test_ids_may_repeat_or_be_text(spark):
    rows = [("b", "one two three " * 5), ("a", "four five six " * 5), ("b", "seven eight nine " * 5), (None, "ten " * 20)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = FD.compare_with_next(df, FD.corpus_ranks(df)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["None", "a", "b", "b"]


def test_texts_of_megabytes(spark):
    long = " ".join(f"word{k}" for k in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, long + " end")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in ED.exact_dedup(df).collect()} == {1: 2, 2: 2, 3: 3}
    assert {r["n_links"] for r in NJ.near_classes(df).collect()} == {2}
    assert all(0 <= r["score"] <= 1 for r in QC.score_quality(df, None).collect())
    assert {r["n_words"] for r in RP.repeated_passages(df).collect()} >= {400_000}
