"""Sets of hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18  # bytes hashed at once
_TABLES: dict[int, np.ndarray] = {}  # made where they are used: they would travel with every task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    if base in _TABLES:
        return _TABLES[base]
    out = np.empty(_SLICE, np.uint64)
    out[0] = 1
    size = 1
    while size < _SLICE:
        out[size : 2 * size] = out[:size] * np.uint64(pow(base, size, 1 << 64))
        size *= 2
    _TABLES[base] = out
    return out


def _hash_slice(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACE[codes], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE)[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE)[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, in order; A-Z count as a-z."""
    data = data.lower()  # for bytes: A-Z only
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        if end < len(data):
            cut = max(data.rfind(bytes([c]), at, end) for c in (32, 10, 9, 11, 12, 13))
            if cut < 0:  # a word longer than a slice: hashed by itself
                stop = min((i for i in (data.find(bytes([c]), end) for c in (32, 10, 9, 11, 12, 13)) if i >= 0), default=len(data))
                found.append(np.array([_long_word(data[at:stop])], np.uint64))
                at = stop
                continue
            end = cut + 1
        found.append(_hash_slice(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _long_word(word: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` make one shingle."""
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(size, len(words))
    joined = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    return np.unique(mix(joined))
