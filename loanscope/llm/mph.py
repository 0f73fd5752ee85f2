"""Minimal perfect hash over distinct 64-bit keys, built and probed with numpy.

Level by level every remaining key takes a slot of an array 1.5 times their
number; slots that exactly one key takes are marked and those keys are done.
A key's index is the number of marked slots before its own.  Keys that occur
twice never part; after ``LEVELS`` levels what is left is kept as a plain list.
"""

from __future__ import annotations

import numpy as np

LEVELS = 48
ROOM = 1.5


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64-bit finaliser of the keys, different at each level."""
    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of each level, marks of all levels packed to bits, order): ``order[i]`` is the key with index i.

    The last ``len(keys) - marks.sum()`` of the order are the keys left over.
    """
    left, sizes, marks, order = np.arange(len(keys)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = int(len(left) * ROOM) + 1
        slot = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        done = alone[slot]
        order.append(left[done][np.argsort(slot[done])])
        sizes.append(size)
        marks.append(alone)
        left = left[~done]
    bits = np.packbits(np.concatenate([*marks, np.zeros(0, bool)]))
    return np.array(sizes, np.int64), bits, np.concatenate([*order, left]).astype(np.int64)


class Index:
    """Probes what ``build`` made; ``keys`` are those left over, which follow the marked ones."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.marks = np.unpackbits(bits)[:int(sizes.sum())].astype(bool)
        self.rank = np.cumsum(self.marks) - self.marks
        self.placed = int(self.marks.sum())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for a key that no level has marked."""
        found, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            slot = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + start
            hit = self.marks[slot]
            found[left[hit]] = self.rank[slot[hit]]
            left, start = left[~hit], start + size
        return found
