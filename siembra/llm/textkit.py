"""Words, shingles and windows of whole Arrow chunks at once, in numpy.

A word is a maximal run of bytes above the space (so any Unicode letter is part of one);
A-Z count as a-z. Hashes are 64-bit and don't depend on the chunk a text is in.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
#: A value for each byte; upper case counts as lower case.
_BYTE = mix(_LOWER + _U(1))
_POWERS: dict[str, np.ndarray] = {}
#: Bytes whose spans are hashed at once; a longer span is a block by itself.
BLOCK = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets (texts + 1) of each text's words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data > 32
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end is the end of its last word
    if len(cuts):
        glued = cuts[inside[cuts + 1] & inside[cuts]]
        starts[glued] = True
        ends[glued] = True
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return first, last, np.searchsorted(first, offsets)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every span; spans ascend and don't overlap."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + BLOCK, "right")))
        low, high = int(first[at]), int(last[to - 1])
        up, down = _powers(high - low + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low:high]] * up[:-1], out=sums[1:])
            a, b = first[at:to] - low, last[at:to] - low
            out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their offsets by text.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    if not out_offsets[-1]:
        return np.zeros(0, np.uint64), out_offsets
    owner = np.repeat(np.arange(len(counts)), made)
    at = offsets[:-1][owner] + np.arange(out_offsets[-1]) - out_offsets[:-1][owner]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    stop = offsets[1:][owner]
    short = (counts < size)[owner]
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            value = padded[at + k] * _STEPS[k]
            if short.any():
                value = np.where(at + k < stop, value, _U(0))
            total += value
        return mix(total + np.where(short, counts[owner], size).astype(np.uint64)), out_offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the segments between ``offsets``; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
