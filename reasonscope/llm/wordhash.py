"""Vectorised hashing of whitespace-separated words and of word windows.

A block of texts is hashed as one byte array. Words are the runs of bytes other
than space and TAB..CR. A word's hash is a polynomial over a random value per
byte, modulo 2**64, read off a prefix sum; windows are hashed the same way over
word hashes. Two independent versions together give 128 bits.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(20260101)).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers, one per version
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown on demand (the kept
    table stays small; longer ones are made for the call)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sum(values[k] * base**(k - start)) for each [start, end)."""
    inverse = pow(base, -1, 2**64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts]


class Words:
    """The words of a block of texts.

    ``doc``: text index of each word; ``starts``/``ends``: byte offsets in
    ``data``; ``hashes``: one array per version.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, versions: int = 1):
        joined = b"\n".join(texts)
        self.bytes = joined.lower() if lower else joined
        self.data = data = np.frombuffer(self.bytes, np.uint8)
        word = np.zeros(len(data) + 2, bool)
        np.logical_not(_SPACE[data], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hashes = [mix(range_sums(_BYTES[v][data], _BASES[v], self.starts, self.ends)
                           + (self.ends - self.starts).astype(np.uint64)) for v in range(versions)]

    def __len__(self) -> int:
        return len(self.starts)

    def word_list(self) -> list[bytes]:
        return self.bytes.split()

    def windows(self, n: int, version: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every window of ``n`` words within one text."""
        h = self.hashes[version]
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1:])
        total = np.zeros(len(h) - n + 1, np.uint64)
        for j, c in enumerate(powers(_BASES[1 - version], n)):
            total += h[j: len(h) - n + 1 + j] * c
        return at, mix(total[at])
