"""A minimal perfect hash over 64-bit keys, as numpy arrays.

Keys are hashed to places of a bit array twice their number; those that stand alone set their bit, the others go on to a
smaller array, and so on. A key's slot is the number of set bits before its own, so n keys have the slots 0 to n - 1 at some
four bits a key. Keys that were not put in get some slot too, so each slot's key is stored and compared."""

from __future__ import annotations

import numpy as np

#: Places per key in each array, and the bits of a word.
ROOM, WORD = 2, np.uint64(64)
NONE = -1


def scattered(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of keys; another for each seed."""
    own = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (keys + own) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _places(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
    return ((scattered(keys, seed) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """Slots of distinct keys; keys[i] is the key of slot i."""

    def __init__(self, keys: np.ndarray):
        rest = np.asarray(keys, np.uint64)
        self.arrays: list[tuple[int, np.ndarray, np.ndarray]] = []
        order, taken = [], 0
        while len(rest):
            size = -(-ROOM * len(rest) // 64) * 64
            at = _places(rest, len(self.arrays), size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.arrays.append((size, words, taken + np.cumsum(counts) - counts))
            order.append(rest[alone][np.argsort(at[alone])])
            taken += len(order[-1])
            rest = rest[~alone]
        self.keys = np.concatenate(order) if order else np.empty(0, np.uint64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, NONE for keys that the hash doesn't hold."""
        out = np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        for seed, (size, words, before) in enumerate(self.arrays):
            if not len(open_):
                break
            at = _places(keys[open_], seed, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            own = words[word] >> bit
            hit = (own & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[open_[hit]] = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            open_ = open_[~hit]
        there = out >= 0
        there[there] = self.keys[out[there]] == keys[there]
        return np.where(there, out, NONE)
