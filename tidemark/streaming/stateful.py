"""Operators with state of their own over transformWithState: a change feed with heartbeats, and lifecycles.

They need the RocksDB state store, which ``started`` sets for the one query that it starts. Rows of a batch that share a key
are taken in order of time, so what a batch gives doesn't depend on how it was partitioned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.streaming import live

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed: seconds without news after which a feed says that it is alive; what a score moves by at least to be news.
HEARTBEAT, LEAST_MOVE = 15, 0.1
#: Fixed: the order of an offering's states, of which the last three end it.
STATES = ("Filed", "Upcoming", "Open", "Closed", "Listed", "Withdrawn", "Not IPO")


def started(spark: SparkSession, start):
    """What start() returns, with the state store that these operators need; the session's setting is put back at once, since a
    query keeps the settings that it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, name: str, checkpoint: str | None = None, clocked: bool = False) -> DataFrame:
    """live.drained with this module's state store."""
    return started(stream.sparkSession, lambda: live.drained(stream, name, "append", checkpoint, clocked))


def _in_order(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    found = list(batches)
    return pd.concat(found, ignore_index=True).sort_values(list(by), kind="stable") if found else pd.DataFrame(columns=list(by))


class ChangeFeed(StatefulProcessor):
    """The newest time of a key, told when it moves; a timer tells that nothing did. State: one time, and one timer."""

    def __init__(self, every: float):
        self.every = int(every * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long")

    def _wait(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.every)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = max((int(x["us"].max()) for x in rows if len(x)), default=None)
        held = self.newest.get()[0] if self.newest.exists() else None
        if seen is not None and (held is None or seen > held):
            self.newest.update((seen,))
            self._wait(timerValues)
            yield pd.DataFrame([(key[0], "data", seen)], columns=["key", "event", "us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._wait(timerValues)
        yield pd.DataFrame([(key[0], "heartbeat", self.newest.get()[0])], columns=["key", "event", "us"])

    def close(self) -> None:
        pass


def _newest(batches, key: str):
    for pdf in batches:
        yield pdf.dropna(subset=[key]).groupby(key, as_index=False)["us"].max().rename(columns={key: "key"})[["key", "us"]]


def change_feed(log: DataFrame, key: str, ts: str, every: float = HEARTBEAT) -> DataFrame:
    """(key, event, us) of a stream of changes: "data" and the newest time in microseconds when it has moved in a batch,
    "heartbeat" and the same time whenever nothing has moved for ``every`` seconds of the clock. Older or equal times are no
    news, null keys and times are passed over. Each task sends a key's newest time alone, so a key with most of the changes
    (or a constant key, for all of them) is no burden."""
    slim = log.filter(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    newest = slim.mapInPandas(lambda batches: _newest(batches, key), "key string, us long")
    return newest.groupBy("key").transformWithStateInPandas(ChangeFeed(every), StructType.fromDDL("key string, event string, us long"), "append", "ProcessingTime")


class Lifecycle(StatefulProcessor):
    """State of an entity in four variables: how far it has come, its last score told, and the flags that it has; they end
    after ``keep_ms`` without a change. The name of each variable has its version, so that one that changes its meaning
    begins anew instead of being read wrongly."""

    VERSION = 1

    def __init__(self, keep_ms: int | None, least: float):
        self.keep_ms, self.least = keep_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        named = lambda x: f"{x}_v{self.VERSION}"
        self.rank = handle.getValueState(named("rank"), "rank int", self.keep_ms)
        self.score = handle.getValueState(named("score"), "score double", self.keep_ms)
        self.flags = handle.getMapState(named("flags"), "flag string", "us long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rank = self.rank.get()[0] if self.rank.exists() else None
        score = self.score.get()[0] if self.score.exists() else None
        began = rank, score
        out: list[tuple] = []
        for us, new_rank, new_score, flag in _in_order(rows, "us", "rank", "score", "flag")[["us", "rank", "score", "flag"]].itertuples(index=False):
            if rank is None:
                out.append((us, "discovered", None))
                rank = -1
            if pd.notna(new_rank) and new_rank > rank and not (rank >= 0 and STATES[rank] in STATES[-3:]):
                out.append((us, "status_changed", STATES[int(new_rank)]))
                rank = int(new_rank)
            if pd.notna(flag) and not self.flags.containsKey((flag,)):
                self.flags.updateValue((flag,), (int(us),))
                out.append((us, "flag_raised", flag))
            if pd.notna(new_score) and (score is None or abs(new_score - score) >= self.least):
                out.append((us, "score_moved", f"{new_score:.4f}"))
                score = float(new_score)
        if rank is not None and rank != began[0]:
            self.rank.update((rank,))
        if score is not None and score != began[1]:
            self.score.update((score,))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "us", "event", "detail"])

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, keep_ms: int | None = None, least: float = LEAST_MOVE) -> DataFrame:
    """(key, us, event, detail) of a stream of (key, us, status, score, flag), us being microseconds: "discovered" when a key
    first comes, "status_changed" when it moves on (never back, and never from a state that ends it; unknown states are passed
    over), "flag_raised" when a flag first comes, "score_moved" when its score has moved by least since last told, the first
    one included. A key without changes for keep_ms of the clock is forgotten and would be discovered again. Null keys are
    left out; a null status, score or flag says nothing."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status")) - 1
    known = F.when(rank >= 0, rank.cast("int"))
    rows = events.filter("key is not null").select(F.col("key").cast("string").alias("key"), F.col("us").cast("long").alias("us"), known.alias("rank"), F.col("score").cast("double").alias("score"), F.col("flag").cast("string").alias("flag"))
    made = StructType.fromDDL("key string, us long, event string, detail string")
    return rows.groupBy("key").transformWithStateInPandas(Lifecycle(keep_ms, least), made, "append", "None" if keep_ms is None else "ProcessingTime")
