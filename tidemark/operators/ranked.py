"""Latest and earliest rows, de-duplication with reasons, average ranks, changes between consecutive rows, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "__rank"


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # Spark turns row_number() <= n into a per-task group limit before the shuffle
    return df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(RANK) == 1).drop(RANK)


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row of each key with the greatest ts; ties go to the greatest tie."""
    return _first(df, keys, [F.desc_nulls_last(ts), F.desc_nulls_last(tie)])


def earliest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    return _first(df, keys, [F.asc_nulls_last(ts), F.asc_nulls_last(tie)])


def latest_values(df: DataFrame, keys: list[str], ts: str, tie: str, values: list[str]) -> DataFrame:
    """As latest(), for a few columns: aggregated before the shuffle, without a sort."""
    best = F.max_by(F.struct(*values), F.struct(ts, tie))
    return df.groupBy(*keys).agg(best.alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def keep_best(df: DataFrame, keys: list[str], completeness: Column, id_col: str) -> DataFrame:
    """Marks each row kept or dropped, with the id that stays: most complete first, then the least id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_full"), F.asc(id_col))
    out = df.withColumn("_full", completeness).withColumns({RANK: F.row_number().over(w), "kept_id": F.first(id_col).over(w)})
    return out.withColumns({"kept": F.col(RANK) == 1, "reason": F.when(F.col(RANK) > 1, F.concat(F.lit("duplicate of "), F.col("kept_id").cast("string")))}).drop(RANK, "_full")


def unique_slugs(df: DataFrame, slug: str, id_col: str) -> DataFrame:
    """slug, bare for the least id that has it and with the id behind it for others."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(id_col))
    return df.withColumn("_n", n).withColumn(slug, F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), F.col(id_col).cast("string")))).drop("_n")


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties sharing their mean. Counts of distinct values are summed up, so no task sorts all rows: values
    are ranked from a table of value counts that is range-partitioned."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    below = running_total(counts, by, value, "_n", "_upto")
    ranks = below.select(*by, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left") if by else df.join(ranks, value, "left")


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The sum of value up to each row within by, in the order of order (which is unique within by).

    With keys it is a window. Without any, ranges of the order are summed in parallel and what lies before each range is
    added: one small row per range is all that meets in one place."""
    if by:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(before), "_part").withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds prev_<column> from the row before, by key: one shuffle for all columns."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {"nth": F.row_number().over(w)})


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """n rows at most; each task keeps no more than n."""
    return df.orderBy(*order).limit(n)
