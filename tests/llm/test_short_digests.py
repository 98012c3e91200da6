from __future__ import annotations

import numpy as np

from siembra.llm import feature_digest as FD


def texts(seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij klmno"), n)) for n in range(32, 201)]


def test_every_length_has_features():
    ranks = np.random.default_rng(3).permutation(FD.BINS)
    for seed in range(20):
        one = texts(seed)
        digests = FD.Digests.of_texts(one, ranks)
        assert (np.diff(digests.offsets) > 0).all()
        assert len(set(digests.strings())) == len(one)
        other = FD.Digests.of_texts(texts(seed + 100), ranks)
        assert FD.likeness(digests, other).max() < 0.7


def test_no_window_with_points_enough():
    for n in (63, 65, 69, 75):
        for ranks in (np.arange(FD.BINS), np.arange(FD.BINS)[::-1].copy()):
            for text in ("x" * n, "".join(chr(97 + k % 26) for k in range(n))):
                assert FD.Digests.of_texts([text], ranks).strings()[0] != "0:"
