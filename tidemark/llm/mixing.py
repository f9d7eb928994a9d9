"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets in words come from weights, a budget and a ceiling per source. Sources are dealt into shards; blocks of equal
numbers of words are apportioned to the shards by highest quotients, which gives each an integer quota. In a shard,
documents lie end to end in a seeded order, the line is cut into blocks, and a seeded selection takes the quota: whole
passes over the line first, then a stride through the blocks. A document takes the words of it that taken blocks cover."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW_KEY, WORD, most_frequent, one_of_each, reliable, row_key

#: Weights by the order of sources, the share of all words to take, and how often a word may be taken.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
REPEATS = 2.0
#: Rows that a shard is meant to have, and the largest block in words.
SHARD_ROWS = 2_000
BLOCK_WORDS = 64


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], budget: float, repeats: float = REPEATS) -> list[float]:
    """Shares of budget by weight, none above repeats times its size; the excess is shared again until none is above."""
    caps, out, left, open_ = [repeats * s for s in sizes], [0.0] * len(sizes), float(budget), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in sorted(open_)) if any(weights[i] for i in open_) else 0.0
        full = [i for i in sorted(open_) if unit * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), none above most; ties go to the first. The divisor is found by halving
    an interval, so the work doesn't grow with the number of seats."""
    seats = int(min(seats, most.sum()))
    votes = np.where(most > 0, votes, 0.0).astype(np.float64)
    if not seats or not votes.any():
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)
    low, high = votes.sum() / seats, votes.sum() / seats
    while given(low).sum() < seats and low > votes[votes > 0].min() * 1e-18:
        low /= 2
    while given(high).sum() > seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    out = given(high)
    while (rest := seats - out.sum()) > 0:  # those that tie at the divisor
        quotients = np.where(out < most, votes / (2 * out + 1), -1.0)
        best = np.argsort(-quotients, kind="stable")[:rest]
        out[best[quotients[best] > 0]] += 1
        if not (quotients[best] > 0).any():
            break
    return out


#: Divisors that one pass over the cells tries.
DIVISORS = 1023


def _given(batches, divisors: np.ndarray):
    """Seats that each divisor gives the cells of a task."""
    total = np.zeros(len(divisors), np.int64)
    for batch in batches:
        votes, most = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for a in range(0, len(votes), 256):
            total += np.minimum(np.floor(votes[a : a + 256, None] / divisors + 0.5), most[a : a + 256, None]).sum(axis=0).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(divisors), dtype=np.int32)), pa.array(total)], ["divisor", "seats"])


def quotas(cells: DataFrame, seats: int) -> DataFrame:
    """cells (number, shard, votes, most) with quota: seats by highest quotients votes / (2 s + 1), none above most, as
    sainte_lague gives them. The cells stay where they are: passes that add up what DIVISORS divisors would give narrow the
    divisor down, and of cells that tie at it, as many as seats are left get one more, chosen by hash."""
    given = lambda d: F.least(F.floor(F.col("votes") / F.lit(float(d)) + 0.5), F.col("most")).cast("long")
    all_votes, least, room = cells.filter("most > 0").agg(F.sum("votes"), F.min(F.when(F.col("votes") > 0, F.col("votes"))), F.sum("most")).first()
    seats = int(min(seats, room or 0))
    if not seats or not least:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low, high = least * 1e-18, 4 * all_votes
    while True:
        spread = np.geomspace(low, high, DIVISORS + 2) if high > 2 * low else np.linspace(low, high, DIVISORS + 2)
        tried = np.unique(spread[(spread > low) & (spread < high)])
        if not len(tried):
            break
        sums = {r["divisor"]: r["seats"] for r in cells.select("votes", "most").mapInArrow(partial(_given, divisors=tried), "divisor int, seats long").groupBy("divisor").agg(F.sum("seats").alias("seats")).collect()}
        enough = [d for i, d in enumerate(tried) if sums[i] >= seats]
        few = [d for i, d in enumerate(tried) if sums[i] < seats]
        low, high = max([low, *enough]), min([high, *few])
    rows = cells.withColumns({"quota": given(high), "_more": given(low)})
    left = seats - (rows.agg(F.sum("quota")).first()[0] or 0)
    ties = reliable(rows.filter("_more > quota").select(F.struct("number", "shard").alias("key"), F.lit(1).alias("n")))
    one = most_frequent(ties, left).select("key.number", "key.shard", F.lit(1).alias("_one"))
    return rows.join(one, ["number", "shard"], "left").withColumn("quota", F.col("quota") + F.coalesce("_one", F.lit(0))).drop("_more", "_one")


def _taken(sizes: np.ndarray, quota: int, block: int, luck: int) -> np.ndarray:
    """Words taken of documents that lie end to end, if quota blocks of the line are taken."""
    total = int(sizes.sum())
    blocks = -(-total // block)
    if not blocks or not quota:
        return np.zeros(len(sizes), np.int64)
    passes, rest = divmod(int(quota), blocks)
    stride = next(x for x in range(int(blocks * 0.6180339887) | 1, 3 * blocks + 3) if math.gcd(x, blocks) == 1)
    chosen = (np.arange(blocks, dtype=np.int64) * stride + luck % blocks) % blocks < rest
    upto = np.concatenate([[0], np.cumsum(np.where(chosen, block, 0))])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at, inside = edges // block, edges % block
    covered = upto[at] + np.where(np.append(chosen, False)[at], inside, 0)
    return passes * sizes + np.diff(covered)


def copies_of(sizes: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Whole copies of documents that come to about the taken words: what rounding leaves is carried to the next one."""
    out, carry = np.empty(len(sizes), np.int32), 0.0
    for i, (size, want) in enumerate(zip(sizes.tolist(), taken.tolist(), strict=True)):
        if not size:
            out[i] = 1
            continue
        times = min(int(REPEATS), max(0, math.floor((want + carry) / size + 0.5)))
        carry += want - times * size
        out[i] = times
    return out


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies (whole ones, to about the same effect), and the
    row's key.

    Sources are ordered by code point, null last, and weigh WEIGHTS in turn; null is a source of its own. A null text has
    no words and takes none. Repeated rows lie one after another and each take what falls to them. The number of sources
    is that of the mixture's own table, which the driver holds; a source of any size is dealt into shards of a few
    thousand rows. The same input gives the same result, however it is partitioned. An empty table gives an empty result."""
    rows = reliable(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias(ROW_KEY), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size")))
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).toLocalIterator()
    sources = sorted(((r["source"], r["words"], r["n"]) for r in found), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in sources]
    goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))], BUDGET * sum(sizes))
    spark = docs.sparkSession
    shards_of = [max(1, -(-n // SHARD_ROWS)) for _, _, n in sources]
    # from Arrow, which no Python worker has to read: rows of a list would have workers, and a daemon, of their own
    columns = {"source": ([s[0] for s in sources], pa.string()), "number": (range(len(sources)), pa.int32()), "shards": (shards_of, pa.int32()), "source_size": (sizes, pa.int64()), "target": ([float(g) for g in goals], pa.float64())}
    table = spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()}))
    numbered = rows.join(F.broadcast(table) if len(sources) <= 100_000 else table, rows["source"].eqNullSafe(table["source"])).drop("source")
    cell = F.pmod(F.xxhash64("id", ROW_KEY, F.lit(seed)), F.col("shards")).cast("int")
    numbered = numbered.withColumn("shard", cell)
    smallest = min((g for g in goals if g > 0), default=1.0)
    block = max(1, min(BLOCK_WORDS, int(smallest // 256)))
    cells = numbered.groupBy("number", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("whole"))
    votes = F.when(F.col("whole") > 0, F.col("target") * F.col("words") / F.col("whole")).otherwise(0.0)
    quota = quotas(reliable(cells.select("number", "shard", votes.alias("votes"), (math.floor(REPEATS) * F.ceil(F.col("words") / block)).alias("most"))), round(sum(goals) / block)).select("number", "shard", "quota")
    kind = docs.schema[id_col].dataType.simpleString()

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["luck", ROW_KEY, "size"], kind="stable")
        pdf["taken"] = _taken(pdf["size"].to_numpy(np.int64), pdf["quota"].iloc[0], block, abs(hash((int(pdf["number"].iloc[0]), int(pdf["shard"].iloc[0]), seed))))
        pdf["copies"] = copies_of(pdf["size"].to_numpy(np.int64), pdf["taken"].to_numpy(np.int64))
        return pdf[["id", ROW_KEY, "size", "source_size", "target", "taken", "copies"]]

    placed = numbered.join(quota, ["number", "shard"]).withColumn("luck", F.xxhash64(ROW_KEY, "id", F.lit(seed + 1)))
    made = placed.drop("shards").groupBy("number", "shard").applyInPandas(select, f"id {kind}, {ROW_KEY} long, size long, source_size long, target double, taken long, copies int")
    return made.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies", ROW_KEY)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once or twice, with all their columns, whatever their names.
    A document without words stays. Of rows that share id and text, copies are made as for all of them, of the one whose
    columns hash lowest."""
    made = mixture(docs, id_col, text_col, source_col).groupBy(ROW_KEY).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("times"))
    made = reliable(made)
    keyed = docs.withColumn(ROW_KEY, row_key(id_col, text_col))
    whole = lambda df: df.select(ROW_KEY, F.struct(*docs.columns).alias("document"))
    out = whole(keyed).join(made.filter("copies > 0 and times = 1"), ROW_KEY)
    twins = made.filter("copies > 0 and times > 1")
    if not twins.isEmpty():
        out = out.unionByName(whole(one_of_each(keyed.join(twins.select(ROW_KEY), ROW_KEY, "left_semi"))).join(twins, ROW_KEY))
    out = out.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])
