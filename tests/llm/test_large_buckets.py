"""Recall of the chosen-path join against brute force where buckets hold more than BUCKET classes."""

from __future__ import annotations

import random

import numpy as np

from siembra.llm import ngram_join as NJ


def drifting(rng, n, clusters):
    """Texts that all begin with one line; in each cluster they drift by one word after another, so links chain."""
    line = [f"common{k}" for k in range(12)]
    rows = []
    for c in range(clusters):
        words = [f"w{c}x{k}" for k in range(60)]
        for _ in range(n // clusters):
            words = list(words)
            words[rng.randrange(60)] = f"n{rng.randrange(10**9)}"
            rows.append(" ".join(line + words))
    return rows


def test_blocks_find_all_pairs():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 3, (700, NJ.COORDS)).astype(np.uint32)
    sketch[500:] = sketch[:200]
    sketch[500:, :20] = 7
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if (sketch[i] == sketch[j]).sum() >= 36}
    assert want == {(int(i), int(j)) for left, right in NJ._near_pairs(sketch, 36) for i, j in zip(left, right, strict=True)}


def test_recall_beyond_the_bucket_size(spark, monkeypatch):
    monkeypatch.setattr(NJ, "BUCKET", 1000)
    rng = random.Random(5)
    texts = drifting(rng, 1600, 8) + drifting(rng, 1200, 1)
    base = texts[0].split()
    for k in range(1200):  # one group of near copies of one text, larger than a bucket
        words = list(base)
        words[20 + k % 50] = f"copy{k}"
        texts.append(" ".join(words))
    assert len(texts) > 2 * NJ.BUCKET
    sets = [frozenset(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    names = {x: k for k, x in enumerate({x for s in sets for x in s})}
    data = np.frombuffer("\0".join(texts).encode(), np.uint8)
    assert len(data) and len(names)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    near = NJ.jaccard_matrix(np.array([names[x] for s in sets for x in s]), offsets) >= 0.8 - 1e-6
    want = near.sum(1) - 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["n_links"] for r in NJ.near_classes(df).collect()}
    found = sum(got.values())
    print("recall", found / want.sum())
    assert all(got[k] <= want[k] for k in got) and found >= 0.99 * want.sum()


def test_links_are_contracted_as_they_come(monkeypatch):
    monkeypatch.setattr(NJ._Links, "HELD", 10)
    rng, links = np.random.default_rng(3), NJ._Links()
    pairs = rng.integers(0, 400, (300, 2))
    for k in range(0, 300, 3):
        links.add(pairs[k : k + 3, 0], pairs[k : k + 3, 1])
        assert sum(map(len, links.left)) < 800
    u, v = links.stars()
    want_u, want_v = NJ.stars(pairs[:, 0], pairs[:, 1])
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == dict(zip(want_u.tolist(), want_v.tolist(), strict=True))
