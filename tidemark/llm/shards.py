"""Sharding by sampled splitters, in DataFrame expressions only.

Rows get a sort key from their content; a size-weighted sample of keys gives quantile boundaries; rows are partitioned by
the range they fall in. Ranges are measured exactly and overfull ones subdivided. With the exact sums of all ranges a
running sum inside each range places every row on one line of bytes, which is cut into equal shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import reliable

#: Sampled keys per range, rows a range is meant to hold, the fewest and most ranges to begin with.
OVERSAMPLE = 16
RANGE_ROWS = 20_000
MIN_RANGES, MAX_RANGES = 256, 1 << 17
#: A range is overfull beyond this many times its fair share; it is split as long as new boundaries part it.
OVERFULL = 3.0
#: Bits of a key, and the most of its first bits that the table of boundaries is joined by.
KEY_BITS, PREFIX_BITS = 63, 16


def _upto(key: Column, bounds: Column, most: int) -> Column:
    """How many of the sorted bounds, most of them at most, are not above key, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.try_element_at(bounds, at + s) <= key, F.lit(False)), at + s).otherwise(at))


def _ranged(rows: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """rows with range: how many of the n bounds are not above key. Boundaries come by a broadcast join on the key's first
    bits; the table has a row for each that there can be, 65,536 at most."""
    power = min(PREFIX_BITS, max(4, n.bit_length()))
    width = KEY_BITS - power
    own = bounds.groupBy(F.shiftright("bound", width).alias("_prefix")).agg(F.sort_array(F.collect_list("bound")).alias("_bounds"))
    every = rows.sparkSession.range(1 << power).select(F.col("id").alias("_prefix")).join(own, "_prefix", "left")
    size = F.when(F.col("_bounds").isNull(), 0).otherwise(F.size("_bounds"))
    earlier = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    found = every.withColumn("_base", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    out = rows.withColumn("_prefix", F.shiftright("key", width)).join(F.broadcast(found), "_prefix")
    return out.withColumn("range", (F.col("_base") + _upto(F.col("key"), F.col("_bounds"), max(1, n))).cast("int")).select(*rows.columns, "range")


def _sample(rows: DataFrame, rate: float, n: int, total: int, *others: str) -> DataFrame:
    """Distinct keys, each taken with a chance in proportion to its row's share of bytes and rows; the same ones on every run."""
    share = (F.col("size") / F.lit(float(max(1, total))) + F.lit(1.0 / max(1, n))) / 2
    luck = (F.xxhash64("key", "size", F.lit(17)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    return rows.filter(luck < share * F.lit(float(rate))).select("key", *others).distinct()


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards differ in bytes by no more than the largest row. size is the text's UTF-8 bytes plus one
    (null: one). Equal texts stand next to each other and part only at a shard's border. slot counts from 0 in each shard
    without gaps. Ties of the key (repeated rows) are numbered in no particular order, which changes no sum. An empty
    table gives an empty result; ids may be null or repeat; extra columns are left out. grown_shard is null."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    crc = F.crc32(body)
    key = F.shiftleft(crc, 31) + F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 31))
    rows = reliable(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), crc.alias("crc"), key.alias("key")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(MIN_RANGES, min(MAX_RANGES, n // RANGE_ROWS))
    # the sample has some 16 keys per range, so it has a bound: a task may number it
    numbered = _sample(rows, ranges * OVERSAMPLE, n, total).withColumn("nth", F.row_number().over(Window.orderBy("key")))
    bounds = reliable(numbered.filter((F.col("nth") > 1) & (F.col("nth") % OVERSAMPLE == 1)).select(F.col("key").alias("bound")))
    while True:
        count = bounds.count()
        sums = reliable(_ranged(rows, bounds, count).groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")))
        fair = F.greatest(F.col("b") / F.lit(float(max(1, total))), F.col("n") / F.lit(float(max(1, n)))) * ranges
        full = sums.withColumn("fair", fair).filter(F.col("fair") > OVERFULL).select("range", "fair")
        if full.isEmpty():
            break
        # overfull ranges are sampled anew, as densely as their weight asks; a single key can't be parted further
        more = _sample(_ranged(rows, bounds, count).join(F.broadcast(full), "range"), ranges * OVERSAMPLE * 4, n, total, "range", "fair")
        of = Window.partitionBy("range")
        step = F.greatest(F.lit(1), F.floor(F.count("*").over(of) / (2 * F.col("fair"))))
        chosen = more.withColumns({"nth": F.row_number().over(of.orderBy("key")) - 1, "step": step}).filter("nth % step = 0")
        new = reliable(chosen.select(F.col("key").alias("bound")).join(bounds, "bound", "left_anti"))
        if new.isEmpty():
            break
        bounds = reliable(bounds.union(new).distinct())
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(out) for c, out in (("b", "before_bytes"), ("n", "before_rows"))])
    inside = Window.partitionBy("range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # partitioned by range, which is what the window asks for: no second shuffle
    placed = _ranged(rows, bounds, count).join(F.broadcast(before), "range").repartitionByRange("range")
    placed = placed.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)})
    middle = (F.col("before_bytes") + F.col("upto")) * 2 - F.col("size")
    placed = placed.select("id", "size", "crc", F.least(F.lit(n_shards - 1), F.floor(middle * F.lit(n_shards) / F.lit(max(1, 2 * total)))).cast("int").alias("shard"), (F.col("before_rows") + F.col("nth") - 1).alias("rank"))
    placed = reliable(placed)
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)])
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.element_at(starts, F.col("shard") + 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
