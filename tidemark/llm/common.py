"""What several operators share: words, checkpoints, bounded chunks of texts, windows of hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bits

#: ASCII white space as a character class, and a word: what stands between it. ``bytes.split()`` cuts at the same places.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset (tests), a folder in the warehouse."""
    own = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{own}/_checkpoints"


def stage_folder(spark: SparkSession) -> str:
    """A new folder's name for tables that are written between the stages of one run."""
    return f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"


#: Has Spark drop an execution's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reliable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share, so that a lost executor costs nothing. What it
    shuffled goes at once, since only the kept rows are read again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def fitted(df: DataFrame, rows: int, each: int = 1 << 16) -> DataFrame:
    """df, of about so many rows, in no more partitions than they need: a shuffle into hundreds would give each of the many
    stages that read a small table hundreds of tasks. The partitions grow with the rows."""
    return df.coalesce(max(1, -(-rows // each)))


def to_driver(df: DataFrame, parts: int = 8) -> Iterator[Row]:
    """The rows of a bounded df, an eighth of them at a time. A local iterator alone would run a job for each partition, one
    after another, after a shuffle into hundreds of small ones."""
    return reliable(df).coalesce(parts).toLocalIterator()


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets the session send no more than some MB at once to Python workers, which hold a batch beside their own tables.
    The setting is read when a plan is made, so it can't be put back before the caller has run what it gets."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if now is None or int(now.rstrip("b")) <= 0 or int(now.rstrip("b")) > most:
        spark.conf.set(name, str(most))


def lean(work: Callable) -> Callable:
    """work, a generator over batches for mapInArrow, that gives back what it held when it ends. Spark keeps its Python workers
    for later tasks, more of them than run at once where a task needs several; what the allocator of an idle one keeps free
    would count beside the tables of those that run."""

    @wraps(work)
    def run(batches, *args, **more):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches, *args, **more)
        finally:
            pa.system_memory_pool().release_unused()

    return run


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8, null as empty, one at a time."""
    for x in batch.column(name).cast(pa.binary()):
        yield x.as_py() or b""


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of which each comes to about limit in size, or is one row."""
    upto, at = np.cumsum(np.maximum(sizes, 1)), 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Chunk(NamedTuple):
    """Word hashes of some whole texts, one after another; text i has words[starts[i]:starts[i + 1]]."""

    keys: np.ndarray
    starts: np.ndarray
    words: np.ndarray

    def at(self) -> np.ndarray:
        """Each word's place in its own text."""
        sizes = np.diff(self.starts)
        return np.arange(len(self.words)) - np.repeat(self.starts[:-1], sizes)

    def left(self) -> np.ndarray:
        """How many words there are from each word to the end of its text, itself included."""
        sizes = np.diff(self.starts)
        return np.repeat(self.starts[1:], sizes) - np.arange(len(self.words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def chunks(batches, limit: int, lower: bool = False) -> Iterator[Chunk]:
    """Whole texts in chunks of about limit words. batches have the columns key (long) and text."""
    keys, sizes, parts, n = [], [0], [], 0

    def made() -> Chunk:
        return Chunk(np.array(keys, np.int64), np.cumsum(sizes), np.concatenate(parts) if parts else np.empty(0, np.uint64))

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
            words = (text.lower() if lower else text).split()
            keys.append(key)
            sizes.append(len(words))
            parts.append(word_hashes(words))
            n += len(words)
            if n >= limit:
                yield made()
                keys, sizes, parts, n = [], [0], [], 0
    if keys:
        yield made()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes: a polynomial modulo 2**64, mixed."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m]
    return mixed(total)


#: Ranges that a search for a border counts at once, and how many rows may be ordered in one task at its end.
RANGES, FEW = 1024, 4096


def _border(df: DataFrame, most: int) -> tuple[int, int, int] | None:
    """(low, high, rest): of df's values v, all above high number most - rest, and those from low to high more than rest.
    The range is narrowed until it is one value or holds FEW rows; each round brings at most RANGES counts to the driver.
    None if there are no more than most."""
    total, low, high = df.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if total <= most:
        return None
    taken, held = 0, total
    while low < high and held > FEW:
        width = -(-(high - low + 1) // RANGES)
        inside = df.filter(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) div {width}L").alias("range")).agg(F.count("*").alias("n"))
        for r in sorted(inside.collect(), key=lambda r: -r["range"]):
            if taken + r["n"] > most:
                low, held = low + r["range"] * width, r["n"]
                high = min(high, low + width - 1)
                break
            taken += r["n"]
    return low, high, most - taken


def most_frequent(df: DataFrame, most: int, key: str = "key", n: str = "n") -> DataFrame:
    """The rows of df with the greatest n, exactly most of them or all; of equal n those whose keys hash highest. df should
    be kept, since it is read several times. Nothing but counts of ranges, and FEW rows at the end, meets one task."""
    if most <= 0:
        return df.limit(0)
    kept = [c for c in df.columns if c not in ("v", "h")]
    ranked = df.select(*kept, F.col(n).cast("long").alias("v"), F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)).alias("h"))
    found = _border(ranked.select("v"), most)
    if found is None:
        return df
    low, high, rest = found
    out = ranked.filter(F.col("v") > high)
    open_ = ranked.filter(F.col("v").between(low, high))
    if low == high and rest:  # ties, as many as there may be
        ties = _border(open_.select(F.col("h").alias("v")), rest)
        if ties is None:
            return out.union(open_).select(*df.columns)
        low, high, rest = ties
        out, open_ = out.union(open_.filter(F.col("h") > high)), open_.filter(F.col("h").between(low, high))
    return out.union(open_.orderBy(F.desc("v"), F.desc("h"), key).limit(rest)).select(*df.columns) if rest else out.select(*df.columns)


#: A key with at least this share of the rows counts as hot; there are at most its inverse of such keys, so they can be broadcast.
HOT_SHARE = 1 / 500
ROW_KEY = "__row_key"


def row_key(id_col: str, text_col: str) -> Column:
    """A row's key: rows that repeat share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows left-joined with table (one row per key; weight: how many of rows have it). Hot keys are few by count, at most
    1 / HOT_SHARE, so they are broadcast; no other key holds more than that share of the shuffle."""
    is_hot = F.col(weight) >= max(2.0, total * HOT_SHARE)
    hot, others = table.filter(is_hot), table.filter(~is_hot)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key, "left"))


def staying(docs: DataFrame, made: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that a decision table (ROW_KEY, kept) keeps; of rows that share a key, one stays at most."""
    keys = reliable(made.groupBy(ROW_KEY).agg(F.max("kept").alias("any"), F.count("*").alias("n")).filter("not any or n > 1"))
    # only rows that may be named by a key shuffle: a filter tells the others apart
    keyed = docs.withColumn(ROW_KEY, row_key(id_col, text_col))
    maybe = bits.among(keys.select(ROW_KEY), keys.count(), "once")(F.col(ROW_KEY))
    alone = keyed.filter(~maybe)
    left = keyed.filter(maybe).join(keys.filter("not any"), ROW_KEY, "left_anti")
    twins = keys.filter("any").select(ROW_KEY)
    if not twins.isEmpty():
        left = left.join(twins, ROW_KEY, "left_anti").unionByName(one_of_each(left.join(twins, ROW_KEY, "left_semi")))
    return alone.unionByName(left).select(docs.columns)


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of rows that share ROW_KEY, the one whose columns hash lowest, so that reruns agree; added up before the shuffle."""
    hashed = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    best = F.min_by(F.struct(*rows.columns), F.xxhash64(*hashed)).alias("__best")
    return rows.groupBy(ROW_KEY).agg(best).select(*[F.col("__best").getField(c).alias(c) for c in rows.columns])
