"""Simple-8b: whole numbers in 64-bit words, coded and decoded by numpy.

A word's upper four bits select how its other 60 are cut: so many values of so many bits each (``CUTS``). Selector ``RUN``
holds one value and how often it repeats; selector ``ESCAPE`` holds the place of a value in a list of raw 64-bit values,
for what 60 bits can't hold. Values are coded in blocks of ``BLOCK``; no word crosses a block's end, and ``Coded.starts``
tells each block's first word, so blocks are coded side by side, one word of each per step, and any range of them decodes
without the others."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Fixed by the coding: (values, bits) of the selectors 2 to 15.
CUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, RUN, FIRST = 0, 1, 2
#: A run's value has 32 bits, its length the 28 above.
RUN_BITS = 32
BLOCK = 1024
_MOST = CUTS[0][0]
#: Bit lengths of all 16-bit numbers: what most ids are.
_BITS = np.repeat(np.arange(17, dtype=np.uint8), [1, *(1 << i for i in range(16))])
_HELD = np.array([1, 0, *(n for n, _ in CUTS)], np.int64)


class Coded(NamedTuple):
    """words of all blocks; block i has words[starts[i]:starts[i + 1]]; raw: values that escaped."""

    words: np.ndarray
    starts: np.ndarray
    raw: np.ndarray


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs; none for 0."""
    if values.max(initial=0) < len(_BITS):
        return _BITS[values]
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> np.uint64(32)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def _selectors(table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The selector of a word that would begin at each place, and how many values it would hold. Both tables have _MOST
    columns of zeros after a block's values."""
    rows = bits[:, :BLOCK]
    selector = np.where(rows > 60, ESCAPE, FIRST + len(CUTS) - 1).astype(np.uint8)
    reach, have = bits.copy(), 1
    peak = reach[:, :BLOCK]
    for s in range(len(CUTS) - 2, -1, -1):
        n, width = CUTS[s]
        while have < n:  # the greatest of the next `have` bit lengths becomes that of the next n
            step = min(have, n - have)
            np.maximum(reach[:, :-step], reach[:, step:], out=reach[:, :-step])
            have += step
        selector[peak <= width] = FIRST + s
    held = _HELD[selector].astype(np.int32)
    change = np.ones((len(table), BLOCK), bool)
    change[:, :-1] = table[:, 1:BLOCK] != table[:, : BLOCK - 1]
    ends = np.where(change, np.arange(1, BLOCK + 1, dtype=np.int32), BLOCK)
    runs = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - np.arange(BLOCK, dtype=np.int32)
    longer = (runs > held) & (rows <= RUN_BITS)
    return np.where(longer, RUN, selector).astype(np.uint8), np.where(longer, runs, held)


def encode(values: np.ndarray) -> Coded:
    """values (whole numbers from 0 to 2**64 - 1) as words. An empty array has no block."""
    values = np.asarray(values).astype(np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return Coded(np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64))
    width = BLOCK + _MOST
    table = np.zeros((blocks, width), np.uint64)
    whole = np.zeros(blocks * BLOCK, np.uint64)
    whole[: len(values)] = values
    table[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    bits = np.zeros((blocks, width), np.uint8)
    bits[:, :BLOCK] = bit_lengths(whole).reshape(blocks, BLOCK)
    selector, held = _selectors(table, bits)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(values) - (blocks - 1) * BLOCK
    begins = np.zeros((blocks, BLOCK), bool)
    open_, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(open_):
        begins[open_, at] = True
        at = at + held[open_, at]
        going = at < sizes[open_]
        open_, at = open_[going], at[going]
    block, place = np.nonzero(begins)
    kind, count = selector[block, place], held[block, place]
    first = block * width + place
    flat, words = table.reshape(-1), kind.astype(np.uint64) << np.uint64(60)
    for s, (n, bits) in enumerate(CUTS, FIRST):
        rows = np.flatnonzero(kind == s)
        if len(rows):
            parts = flat[first[rows][:, None] + np.arange(n)]
            words[rows] |= np.bitwise_or.reduce(parts << (np.arange(n, dtype=np.uint64) * np.uint64(bits)), axis=1)
    rows = np.flatnonzero(kind == RUN)
    words[rows] |= flat[first[rows]] | (np.minimum(count[rows], sizes[block[rows]] - place[rows]).astype(np.uint64) << np.uint64(RUN_BITS))
    rows = np.flatnonzero(kind == ESCAPE)
    words[rows] |= np.arange(len(rows), dtype=np.uint64)
    return Coded(words, np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))]).astype(np.int64), flat[first[rows]])


def decode(coded: Coded, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of the blocks from first to before last (all of them if None); n: how many values all blocks have."""
    blocks = len(coded.starts) - 1
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, np.uint64)
    words = coded.words[coded.starts[first] : coded.starts[last]]
    begin = coded.starts[first : last + 1] - coded.starts[first]
    sizes = np.full(last - first, BLOCK)
    if last == blocks:
        sizes[-1] = n - (blocks - 1) * BLOCK
    kind = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    held = _HELD[kind]
    held[kind == RUN] = (body[kind == RUN] >> np.uint64(RUN_BITS)).astype(np.int64)
    before = np.cumsum(held) - held
    inside = before - np.repeat(before[begin[:-1]], np.diff(begin))
    ends = begin[1:] - 1  # only a block's last word may have room left
    held[ends] = sizes - inside[ends]
    at = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.diff(begin)) + inside
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s, (count, bits) in enumerate(CUTS, FIRST):
        rows = np.flatnonzero(kind == s)
        if len(rows):
            parts = (body[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            there = np.arange(count) < held[rows][:, None]
            out[(at[rows][:, None] + np.arange(count))[there]] = parts[there]
    rows = np.flatnonzero(kind == RUN)
    if len(rows):
        places = np.repeat(at[rows] - (np.cumsum(held[rows]) - held[rows]), held[rows]) + np.arange(int(held[rows].sum()))
        out[places] = np.repeat(body[rows] & np.uint64((1 << RUN_BITS) - 1), held[rows])
    rows = np.flatnonzero(kind == ESCAPE)
    out[at[rows]] = coded.raw[body[rows].astype(np.int64)]
    return out
