"""Outcomes that come late: predictions wait for their price, and those that got none are tried again.

A prediction waits from the moment it is due for ``within``; the first price of its key in that time is its outcome. This is
a stream-stream outer join over an interval, followed by a minimum per prediction: state holds predictions and prices only as
long as the watermarks of both sides allow a match, and a prediction without one leaves as BLOCKED when they have passed.
A retry is the same join over an interval that begins some days later. It reads the predictions themselves, not what an
earlier attempt wrote, so it is never late for its own watermark, and what it finds doesn't depend on when batches ran."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.live import drained

#: Fixed: days after which what was blocked is tried again.
RETRY_DAYS = 14
GRADED, BLOCKED, PENDING = "GRADED", "BLOCKED_MARKET_DATA", "PENDING"


def attached(predictions: DataFrame, prices: DataFrame, within: str, late: str = "1 day", attempt: int = 1, after: str = f"{RETRY_DAYS} DAYS") -> DataFrame:
    """(id, key, due, attempt, at, price, category): each prediction (id, key, due) of a stream with the first price (key, at,
    price) of its key in the ``within`` that begins when it is due, or (attempt - 1) times ``after`` later; at and price are
    null and it is BLOCKED if none came by then.

    A prediction leaves when the watermarks, late behind the newest row of either stream, have passed the end of its time;
    until then it is in no row. Of prices at one moment the lowest counts; predictions that repeat leave once. Null keys match
    nothing, null times are left out."""
    left = predictions.filter("due is not null").select("id", F.col("key").alias("of"), "due").withWatermark("due", late)
    right = prices.filter("at is not null and price is not null").select("key", "at", "price").withWatermark("at", late)
    begin = F.col("due")
    for _ in range(1, attempt):
        begin = begin + F.expr(f"INTERVAL {after}")
    inside = (F.col("of") == F.col("key")) & (F.col("at") >= begin) & (F.col("at") <= begin + F.expr(f"INTERVAL {within}"))
    found = left.join(right, inside, "left_outer")
    first = found.groupBy("due", "id", "of").agg(F.min(F.when(F.col("at").isNotNull(), F.struct("at", "price"))).alias("first"))
    return first.select("id", F.col("of").alias("key"), "due", F.lit(attempt).alias("attempt"), "first.at", "first.price", F.when(F.col("first").isNull(), BLOCKED).otherwise(GRADED).alias("category"))


def settled(predictions: DataFrame, prices: DataFrame, within: str, attempts: int = 2, after: str = f"{RETRY_DAYS} DAYS", late: str = "1 day", checkpoint: str | None = None) -> DataFrame:
    """(id, key, due, attempt, at, price, category) of the predictions of a stream of which some attempt has left: the first that
    was graded, else the last that was blocked. All attempts are one query; with the same checkpoint a later call goes on where
    this one ended, so prices that came meanwhile settle what was waiting."""
    tried = [attached(predictions, prices, within, late, n, after) for n in range(1, attempts + 1)]
    made = drained(reduce(DataFrame.unionByName, tried), "outcomes", "append", checkpoint)
    best = F.min_by(F.struct(*[c for c in made.columns if c not in ("id", "due")]), F.when(F.col("category") == GRADED, F.col("attempt")).otherwise(attempts + 1 - F.col("attempt") + attempts))
    return made.groupBy("id", "due").agg(best.alias("best")).select("id", "best.key", "due", "best.attempt", "best.at", "best.price", "best.category")
