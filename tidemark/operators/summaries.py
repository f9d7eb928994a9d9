"""Counts, coverage, bands and quantiles, with closed vocabularies filled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: the bands that scores are reported in.
BANDS = ((0, 40), (40, 50), (50, 60), (60, 70), (70, 80), (80, 101))


def zero_filled(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(column, n) for each word of the vocabulary, in its order, also where nothing has it."""
    words = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], f"{column} string, nth int")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return words.join(counts, column, "left").select(column, "nth", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by outer and inner, by outer, and in all: one pass."""
    return df.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def coverage(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """The share of rows that have each column, in one pass."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"has_{c}") for c in columns])


def index_quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """The values at index int(share * n) of the sorted known values. Values are counted first, so that what is gathered
    per group is its distinct values, and even these only as running totals."""
    from tidemark.operators.ranked import running_total

    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    upto = running_total(counts, by, value, "_n", "_upto").join(total, by)
    at = lambda s: F.least(F.col("_all") - 1, F.floor(F.col("_all") * s))
    return upto.groupBy(*by).agg(F.first("_all").alias("n"), *[F.min(F.when(F.col("_upto") > at(s), F.col(value))).alias(name) for name, s in shares.items()])


def bands(df: DataFrame, score: str, value: str) -> DataFrame:
    """Per band of score: n, and of the values their mean, median and shares above 0, 10, 20 and below 0; empty bands too."""
    labels = [f"{a}-{min(b, 100)}" for a, b in BANDS]
    band = F.coalesce(*[F.when((F.col(score) >= a) & (F.col(score) < b), F.lit(x)) for (a, b), x in zip(BANDS, labels, strict=True)])
    share = lambda c: F.avg(c.cast("int")) * 100
    v = F.col(value)
    made = df.filter(v.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"), share(v > 0).alias("positive"), F.avg(v).alias("mean"), F.median(v).alias("median"), share(v > 10).alias("above_10"), share(v > 20).alias("above_20"), share(v < 0).alias("loss"))
    words = df.sparkSession.createDataFrame([(x,) for x in labels], "band string")
    return words.join(made, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def facets(df: DataFrame, column: str, most: int = 40) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(most)


def worst(df: DataFrame, by: list[str], status: str, severity: dict[str, int]) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])[F.col(status)]
    return df.groupBy(*by).agg(F.max_by(status, F.struct(F.coalesce(rank, F.lit(-1)), F.col(status))).alias("worst"))


def partitioned(df: DataFrame, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket, and the counts of all buckets, which add up to the rows."""
    out = df.withColumn("bucket", bucket)
    return out, out.groupBy("bucket").agg(F.count("*").alias("n"))
