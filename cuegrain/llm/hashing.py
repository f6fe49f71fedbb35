"""Vectorised hashes of words, shingles and byte windows over many texts at once.

A hash of bytes b_i..b_j is the sum of T[b_k] * P**(k - i) modulo 2**64, with T a fixed random
table and P odd, so one running sum gives every word and every window of a buffer; a final
mix spreads it over all bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches each output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers_cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 23:
            _powers_cache[base] = have
    return have[:n]


class Rolling:
    """Hashes of any range of one buffer of bytes, or of code points."""

    def __init__(self, buf: np.ndarray):
        values = _TABLE[buf] if buf.dtype == np.uint8 else mix(buf.astype(np.uint64) + np.uint64(1))
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(_BASE, len(buf)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(buf) + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + length)

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of `width` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and where each text's words begin (one more than texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    edges = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=edges[1:])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        turn = np.concatenate(([0], turn))
    starts, ends = turn[0::2], turn[1::2]
    ends = ends if len(ends) == len(starts) else np.append(ends, len(buf))
    hashes = Rolling(buf).ranges(starts, ends)
    return hashes, np.searchsorted(starts, edges)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text has its one run of all words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = words[:n].copy()
    for j in range(1, width):
        out = mix(out * np.uint64(_BASE) + words[j : n + j])
    return np.unique(out)
