"""A queue of messages that is worked off in cycles: order, back-off, consent and quotas, and a send that may fail.

The queue is a table of versions, one a cycle. A cycle reads the version before its own and writes a whole new one, and what is
tried in it is written before it is sent; so a cycle that died is done again over the same messages, and one that is done does
nothing when it comes again. What is tried is a limited first part of an order, which no task but the last sees whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.basic import pick

#: Fixed: states of a message; seconds of the first wait and of the longest; the priority up to which quotas don't hold; how often
#: a message is tried.
QUEUED, SENT, FAILED, SUPPRESSED, UNSUBSCRIBED = "QUEUED", "SENT", "FAILED", "SUPPRESSED", "UNSUBSCRIBED"
FIRST_WAIT, LONGEST_WAIT, TRANSACTIONAL, MOST_ATTEMPTS = 30, 3600, 1, 5
MESSAGES = "id long, recipient string, template string, priority int, queued_at long, status string, attempts int, tried_at long, sent_at long"


def waits(attempts: Column, tried_at: Column, now: int) -> Column:
    """Whether a message waits after a failure: twice as long each time, an hour at most."""
    wait = F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.least(attempts, F.lit(20))))
    return (attempts > 0) & (F.lit(now) - tried_at < wait)


def due(queue: DataFrame, recipients: DataFrame, now: int, limit: int, room: int | None) -> tuple[DataFrame, DataFrame]:
    """(ended, tried): messages that end without being sent, with their new status, and the first limit of those to be tried, by
    priority, then time, then id. Of messages that quotas hold for, at most room are among them (None: no quota).
    recipients: recipient, suppressed, consent; an unknown recipient counts as suppressed."""
    known = recipients.groupBy("recipient").agg(F.bool_or("suppressed").alias("suppressed"), F.bool_and("consent").alias("consent"))
    open_ = queue.filter(F.col("status") == QUEUED).filter(~waits(F.col("attempts"), F.col("tried_at"), now)).join(known, "recipient", "left")
    end = pick((F.coalesce("suppressed", F.lit(True)), SUPPRESSED), ((F.col("template") != "welcome") & ~F.coalesce("consent", F.lit(False)), UNSUBSCRIBED), otherwise=None)
    open_ = open_.withColumn("end", end)
    ended = open_.filter("end is not null").select("id", F.col("end").alias("status"))
    order = [F.asc("priority"), F.asc("queued_at"), F.asc("id")]
    ready = open_.filter("end is null").select("id", "recipient", "template", "priority", "queued_at", "attempts")
    if room is None:
        return ended, ready.orderBy(*order).limit(limit)
    free, held = ready.filter(F.col("priority") <= TRANSACTIONAL), ready.filter(F.col("priority") > TRANSACTIONAL)
    first = free.orderBy(*order).limit(limit).unionByName(held.orderBy(*order).limit(max(0, min(limit, room))))
    return ended, first.orderBy(*order).limit(limit)


class Queue:
    """Messages under ``path``, a folder that the cluster shares. send takes the tried messages and returns id, ok and
    retryable for each; it must not send an id twice within one cycle, since a cycle that died sends again."""

    def __init__(self, spark: SparkSession, path: str, send: Callable[[DataFrame], DataFrame], limit: int = 25, daily: int | None = None, monthly: int | None = None):
        self.spark, self.path, self.send, self.limit, self.daily, self.monthly = spark, path, send, limit, daily, monthly

    def _done(self) -> int:
        """The last cycle that is done; 0 if none is."""
        try:
            return self.spark.read.schema("cycle int").parquet(f"{self.path}/done").agg(F.max("cycle")).first()[0] or 0
        except AnalysisException:
            return 0

    def messages(self, cycle: int | None = None) -> DataFrame:
        cycle = self._done() if cycle is None else cycle
        if not cycle:
            return self.spark.createDataFrame([], MESSAGES)
        return self.spark.read.schema(MESSAGES).parquet(f"{self.path}/cycle={cycle}")

    def _room(self, queue: DataFrame, day: int, month: int) -> int | None:
        """How many more messages the quotas of the day and the month allow."""
        n = queue.filter(F.col("status") == SENT).agg(F.count_if(F.col("sent_at") >= day), F.count_if(F.col("sent_at") >= month)).first()
        left = [most - had for most, had in ((self.daily, n[0]), (self.monthly, n[1])) if most is not None]
        return min(left) if left else None

    def run(self, cycle: int, now: int, new: DataFrame, recipients: DataFrame, day: int, month: int) -> bool:
        """Takes new messages in (ids that it has are passed over) and works off what is due. Cycles are numbered from 1, one
        after another; one that is done isn't done again (False)."""
        done = self._done()
        if cycle <= done:
            return False
        if cycle != done + 1:
            raise ValueError(f"cycle {cycle} after {done}")
        before = self.messages(done)
        fresh = new.dropDuplicates(["id"]).join(before.select("id"), "id", "left_anti").select("id", "recipient", "template", "priority", "queued_at", F.lit(QUEUED).alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("tried_at"), F.lit(None).cast("long").alias("sent_at"))
        queue = before.unionByName(fresh)
        ended, tried = due(queue, recipients, now, self.limit, self._room(before, day, month))
        tried.write.mode("overwrite").parquet(f"{self.path}/tried={cycle}")
        results = self.send(self.spark.read.parquet(f"{self.path}/tried={cycle}")).select("id", "ok", "retryable")
        results.write.mode("overwrite").parquet(f"{self.path}/results={cycle}")
        results = self.spark.read.schema("id long, ok boolean, retryable boolean").parquet(f"{self.path}/results={cycle}").groupBy("id").agg(F.bool_or("ok").alias("ok"), F.bool_and("retryable").alias("retryable"))
        j = queue.join(ended.withColumnRenamed("status", "_end"), "id", "left").join(results.withColumn("_tried", F.lit(True)), "id", "left")
        attempts = F.col("attempts") + F.when(F.col("_tried"), 1).otherwise(0)
        status = pick((F.col("_end").isNotNull(), F.col("_end")), (F.col("_tried") & F.col("ok"), SENT), (F.col("_tried") & (~F.col("retryable") | (attempts >= MOST_ATTEMPTS)), FAILED), otherwise=F.col("status"))
        after = j.select("id", "recipient", "template", "priority", "queued_at", status.alias("status"), attempts.alias("attempts"), F.when(F.col("_tried"), now).otherwise(F.col("tried_at")).cast("long").alias("tried_at"), F.when(F.col("_tried") & F.col("ok"), now).otherwise(F.col("sent_at")).cast("long").alias("sent_at"))
        after.write.mode("overwrite").parquet(f"{self.path}/cycle={cycle}")
        self.spark.createDataFrame([(cycle,)], "cycle int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/n={cycle}")
        return True
