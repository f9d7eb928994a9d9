"""Streams: windowed counts, sessions, sliding limits, de-duplication, and snapshots that are written when something moved."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.sinks import shared_folder


def tumbling(events: DataFrame, ts: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window; what comes later than late behind the newest event is left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def over_limit(events: DataFrame, ts: str, key: str, limit: int, width: str = "60 seconds", step: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Windows in which a key had more events than allowed: a report over fixed steps; limited() decides event by event."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step), key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def limited(events: DataFrame, ts: str, key: str, limit: int, seconds: float = 60.0, late: str = "5 minutes") -> DataFrame:
    """(key, ts, rejected): each event, and whether its key already had limit accepted ones in the seconds before it. What
    is rejected isn't recorded, so a key can't prolong its own wait. State is at most limit times per key; a key without
    events for a window behind the watermark is forgotten, so idle keys cost nothing. ts is a timestamp."""

    def update(k: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(ts)
        out = []
        for t, at in zip(pdf[ts], pdf[ts].astype("datetime64[us]").astype("int64") / 1e6, strict=True):
            held = [x for x in held if x > at - seconds]
            out.append((k[0], t, len(held) >= limit))
            if not out[-1][2]:
                held.append(at)
        state.update((held,))
        newest = max([*held, 0.0])
        state.setTimeoutTimestamp(int(max(newest + seconds, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield pd.DataFrame(out, columns=[key, ts, "rejected"])

    kinds = dict(events.dtypes)
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, {ts} {kinds[ts]}, rejected boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def snapshots(events: DataFrame, key: str, ts: str, value: str, least: float, keep: str | None = None) -> DataFrame:
    """(key, ts, value, before): an entity's value when it first comes and whenever it moved by least or more since the
    last one written. Events of a batch are taken in order of time; state is one number per entity. keep: how long an
    entity without events is remembered (by event time, ts being a timestamp); without it, forever."""

    def update(k: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values([ts, value])
        out = []
        for t, v in zip(pdf[ts], pdf[value], strict=True):
            if last is None or abs(v - last) >= least:
                out.append((k[0], t, float(v), last))
                last = float(v)
        if last is not None:
            state.update((last,))
            if keep:
                newest = pdf[ts].max().timestamp() * 1000
                state.setTimeoutTimestamp(int(max(newest, state.getCurrentWatermarkMs()) + pd.Timedelta(keep).total_seconds() * 1000 + 1))
        yield pd.DataFrame(out, columns=[key, ts, value, "before"]).astype({value: "float64", "before": "float64"})

    kinds = dict(events.dtypes)
    timed = events.withWatermark(ts, "1 hour") if keep else events
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {value} double, before double", "last double", "append", GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout)


#: Fixed: the shortest cycle in seconds, and after how many cycles performance and history are refreshed.
SHORTEST, PERFORMANCE_EVERY, HISTORY_EVERY = 60, 4, 96


def trigger(interval: int = 900) -> dict[str, str]:
    """For writeStream.trigger(): a cycle every interval seconds, not more often than once a minute."""
    return {"processingTime": f"{max(SHORTEST, interval)} seconds"}


def due_jobs(cycle: int) -> list[str]:
    """What the cycle of that number (from 0) runs besides ingesting."""
    return ["ingest", *(["performance"] if cycle % PERFORMANCE_EVERY == 0 else []), *(["history"] if cycle % HISTORY_EVERY == 0 else [])]


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None, clocked: bool = False) -> DataFrame:
    """Runs a stream over what there is and returns its result as a table of Parquet files in the shared folder. A batch
    that is run again overwrites its own files; with the same checkpoint a later call goes on where this one ended. In
    complete mode the last batch is the result, else all of them. clocked: the stream waits for a clock, so it would never have
    nothing left to do; all that there is makes one batch."""
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    rows = f"{checkpoint}_rows"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{rows}/batch={batch}")

    stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**({"once": True} if clocked else {"availableNow": True})).foreachBatch(keep).start().awaitTermination()
    try:
        found = spark.read.schema(stream.schema.add("batch", "long")).parquet(rows)
    except AnalysisException:  # nothing came, so nothing was written
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        found = found.filter(F.col("batch") == (found.agg(F.max("batch")).first()[0] or 0))
    return found.drop("batch")
