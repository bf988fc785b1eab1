"""Shingle sets and fast similarity sketches of texts.

The sketch has SIZE coordinates that SIZE * 2 rounds fill. In each of the first SIZE rounds every element is put, by a hash
of the round, into one of the SIZE bins; in round SIZE + j all elements are put into bin j. A coordinate keeps the least
element of the first round that reached its bin, so all are filled at the end, and mostly after a few rounds. Two sets agree
in a coordinate with the probability of their Jaccard similarity, with the concentration of independent choices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SIZE = 128
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


_odd = mix(np.arange(1, 65, dtype=np.uint64) * MIX[0]) | np.uint64(1)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, of the whole sequence; of none, nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _odd[i]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def fingerprint(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The coordinates, as unsigned 32-bit hashes; elements: at least one 64-bit hash."""
    out, filled, left = np.zeros(size, np.uint32), np.zeros(size, bool), size
    shift = np.uint64(64 - size.bit_length() + 1)
    for i in range(2 * size):
        h = mix(elements + np.uint64(i + 1) * MIX[0])
        if i < size:
            h.sort()
            bins = (h >> shift).astype(np.int64)
            first = np.concatenate(([True], bins[1:] != bins[:-1])) & ~filled[bins]
            bins, h = bins[first], h[first]
        else:
            if filled[i - size]:
                continue
            bins, h = np.array([i - size]), h.min(keepdims=True)
        out[bins] = mix(h + np.uint64(i)).astype(np.uint32)
        filled[bins] = True
        left -= len(bins)
        if not left:
            break
    return out
