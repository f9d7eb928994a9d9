"""A Bloom filter in shards that many tasks fill and whose size has a bound.

A 64-bit hash has a shard (from its upper half) and a 32-bit value in it (its lower half). Tasks send distinct values,
packed, to their shard, in parts by value if there are many; a part knows which of its values came more than once and turns
them into bits, which the shard unites. The size in bits follows the number of items up to ``MAX_SHARDS``; beyond it a
filter lets more through, which costs time but never changes a result, because all that it lets through is compared
exactly afterwards. The number of parts follows the items without a bound, so no group grows with the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a shard, as a power of two, and the most shards: 128 MiB in all.
SHARD_POWER = 20
MAX_SHARDS = 1024
SENT = "shard int, part int, once binary, twice binary"
#: Values that a part of a shard is meant to get.
PART_VALUES = 1 << 20
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shards_for(items: int, bits_each: int = 10) -> int:
    return max(1, min(MAX_SHARDS, -(-items * bits_each // (1 << SHARD_POWER))))


def parts_for(items: int, shards: int) -> int:
    return max(1, -(-items // (shards * PART_VALUES)))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _places(values: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of 32-bit values (as uint64)."""
    for m in _MULTIPLIERS:
        yield (values * m) >> np.uint64(64 - SHARD_POWER)


def packed(h: np.ndarray, shards: int, parts: int = 1) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of SENT for hashes (repeats included): the distinct values of each part, and those among them seen twice."""
    keys, n = np.unique((_shard(h, shards) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_counts=True)
    low = keys.astype(np.uint32)
    owner = (keys >> np.uint64(32)).astype(np.int64) * parts + (low.astype(np.int64) * parts >> 32)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if b > a:
            yield *divmod(int(owner[a]), parts), low[a:b].tobytes(), low[a:b][n[a:b] > 1].tobytes()


def sent(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    s, p, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(p, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["shard", "part", "once", "twice"])


def _bits(values: np.ndarray) -> bytes:
    out = np.zeros(1 << SHARD_POWER, bool)
    for p in _places(values.astype(np.uint64)):
        out[p] = True
    return np.packbits(out, bitorder="little").tobytes()


def _either(table: pa.Table) -> pa.Table:
    """The bits of a shard from those of its parts."""
    both = lambda name: np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column(name).to_pylist()]).tobytes()
    return _table(table, both("once"), both("twice"))


def _merge(table: pa.Table) -> pa.Table:
    arrays = lambda name: np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(name).to_pylist()])
    values, n = np.unique(arrays("once"), return_counts=True)
    return _table(table, _bits(values), _bits(np.concatenate([values[n > 1], arrays("twice")])))


def _table(made_of: pa.Table, once: bytes, twice: bytes) -> pa.Table:
    return pa.table({"shard": pa.array([made_of.column("shard")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([twice], pa.binary())})


def filled(rows: DataFrame, shards: int, *names: str, parts: int = 1) -> list[np.ndarray]:
    """The filters (bytes of bits, shard after shard) for rows of SENT: names are once and twice. At most 128 MiB each."""
    from tidemark.llm.common import to_driver

    out = [np.zeros((shards, 1 << (SHARD_POWER - 3)), np.uint8) for _ in names]
    made = rows.groupBy("shard", "part").applyInArrow(_merge, SENT)
    made = made if parts == 1 else made.groupBy("shard").applyInArrow(_either, SENT)
    for row in to_driver(made.select("shard", *names)):
        for bits, name in zip(out, names, strict=True):
            bits[row["shard"]] = np.frombuffer(row[name], np.uint8)
    return [x.reshape(-1) for x in out]


def passes(bits: np.ndarray, shards: int, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among those that filled bits."""
    base, values = _shard(h, shards) << np.uint64(SHARD_POWER), h & np.uint64(0xFFFFFFFF)
    out = np.ones(len(h), bool)
    for p in _places(values):
        at = base | p
        out &= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
    return out


def _emit(batches, shards: int, parts: int, made: Callable | None = None):
    for batch in made(batches) if made else batches:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield sent(list(packed(h, shards, parts)))


def held(hashes: DataFrame, items: int, name: str, bits_each: int = 16, made: Callable | None = None) -> tuple[Broadcast, int]:
    """The filter, broadcast, and its shards: of a column of longs (once), or of those that it holds twice or more (twice).
    made: makes batches of longs from those of hashes, in the Python worker that packs them; one task then needs one worker."""
    from tidemark.llm.common import lean

    shards = shards_for(items, bits_each)
    parts = parts_for(items, shards)
    (found,) = filled(hashes.mapInArrow(lean(partial(_emit, shards=shards, parts=parts, made=made)), SENT), shards, name, parts=parts)
    return hashes.sparkSession.sparkContext.broadcast(found), shards


def among(hashes: DataFrame, items: int, name: str) -> Callable[[Column], Column]:
    """Whether a hash may be among those of a column of longs (once), or among those that it holds twice or more (twice)."""
    shared, shards = held(hashes, items, name)

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        return pd.Series(passes(np.frombuffer(shared.value, np.uint8), shards, h.to_numpy().view(np.uint64)))

    return may_be
