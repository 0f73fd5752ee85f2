"""Words of many texts at once as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

# Fixed value: an odd multiplier; powers of its inverse undo it modulo 2**64.
BASE = 0x5851F42D4C957F2D
_INVERSE = pow(BASE, -1, 1 << 64)
# Bytes hashed at once; a longer text is cut between words.
AT_ONCE = 4 << 20

# Letters, digits and every byte of a non-ASCII character are word bytes.
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Word bounds and hashes of one byte string; keeps its power tables between calls."""

    def __init__(self):
        self.up, self.down = powers(BASE, 0), powers(_INVERSE, 0)

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IS_WORD[data]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each word."""
        out, first = [], 0
        while first < len(starts):
            last = int(np.searchsorted(ends, starts[first] + AT_ONCE, side="right"))
            last = max(last, first + 1)
            at, to = int(starts[first]), int(ends[last - 1])
            if len(self.up) < to - at + 1:
                self.up, self.down = powers(BASE, to - at + 1), powers(_INVERSE, to - at + 1)
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * self.up[:to - at], out=sums[1:])
            s, e = starts[first:last] - at, ends[first:last] - at
            out.append(mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64)))
            first = last
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order."""
    n = max(len(words) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
        total ^= total >> np.uint64(29)
    return mix(total)
