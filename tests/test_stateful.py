"""Operators with their own state against brute force: order of batches, restarts, timers by a clock of the test."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import stateful


class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Handle:
    """A handle's values and timers, in memory."""

    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema, ttl=None):
        class Value:
            held = None

            def exists(self):
                return self.held is not None

            def get(self):
                return self.held

            def update(self, v):
                self.held = v

        return Value()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_a_feed_tells_news_at_once_and_beats_when_nothing_comes():
    import pandas as pd

    feed, handle, clock = stateful.ChangeFeed(15), Handle(), Clock()
    feed.init(handle)
    told = lambda found: [tuple(r) for x in found for r in x.itertuples(index=False)]
    put = lambda *us: told(feed.handleInputRows(("k",), iter([pd.DataFrame({"us": list(us)})]), clock))

    def until(now):
        out = []
        while due := [t for t in handle.timers if t <= now]:
            clock.now = min(due)
            handle.timers.remove(clock.now)
            out += [(clock.now, r) for r in told(feed.handleExpiredTimer(("k",), clock, None))]
        clock.now = now
        return out

    assert put(5, 9, 7) == [("k", "data", 9)] and put(9, 3) == []
    assert until(40_000) == [(15_000, ("k", "heartbeat", 9)), (30_000, ("k", "heartbeat", 9))]
    assert put(10) == [("k", "data", 10)] and handle.timers == [55_000]  # news put the next beat off
    assert until(54_999) == [] and [t for t, _ in until(70_000)] == [55_000, 70_000]


def test_a_running_feed_beats_by_the_clock(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([("a", 1), ("a", 3), (None, 9), ("b", None)], "k string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(folder)
    log = spark.readStream.schema("k string, s long, ts timestamp").parquet(folder)
    got = []

    def keep(df, batch):
        got.extend((batch, *r) for r in df.collect())

    query = stateful.started(spark, lambda: stateful.change_feed(log, "k", "ts", 1.0).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    end = time.time() + 120
    while sum(r[2] == "heartbeat" for r in got) < 2 and time.time() < end and query.exception() is None:
        time.sleep(0.5)
    query.stop()
    assert [r[1:] for r in got if r[2] == "data"] == [("a", "data", 3_000_000)]
    assert sum(r[2] == "heartbeat" for r in got) >= 2 and {r[1:] for r in got if r[2] == "heartbeat"} == {("a", "heartbeat", 3_000_000)}


def brute(batches, least):
    """Events of lifecycles, batch after batch, one row at a time."""
    ends = {"Listed", "Withdrawn", "Not IPO"}
    state, out = {}, set()
    for batch in batches:
        for key, us, status, score, flag in sorted(batch, key=lambda r: (r[1], (r[2] not in stateful.STATES, stateful.STATES.index(r[2]) if r[2] in stateful.STATES else 0), (r[3] is None, r[3] or 0), (r[4] is None, r[4] or ""))):
            if key is None:
                continue
            s = state.get(key)
            if s is None:
                s = state[key] = {"status": None, "score": None, "flags": set()}
                out.add((key, us, "discovered", None))
            if status in stateful.STATES and s["status"] not in ends and (s["status"] is None or stateful.STATES.index(status) > stateful.STATES.index(s["status"])):
                s["status"] = status
                out.add((key, us, "status_changed", status))
            if flag is not None and flag not in s["flags"]:
                s["flags"].add(flag)
                out.add((key, us, "flag_raised", flag))
            if score is not None and (s["score"] is None or abs(score - s["score"]) >= least):
                s["score"] = score
                out.add((key, us, "score_moved", f"{score:.4f}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lifecycles_go_on_after_a_restart_and_never_back(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(10**6), rng.choice([*stateful.STATES, "odd", None]), rng.choice([None, rng.randrange(100) / 32]), rng.choice([None, None, "x", "y"])) for _ in range(80)]
    batches = [rows[a : a + 20] for a in range(0, 80, 20)]
    kind = "key string, us long, status string, score double, flag string"
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for batch in batches:  # a stream for each: the next one goes on from the checkpoint
        spark.createDataFrame(batch, kind).repartition(3).write.mode("append").parquet(folder)
        found = stateful.drained(stateful.lifecycles(spark.readStream.schema(kind).parquet(folder)), "lifecycles", state)
    assert {tuple(r) for r in found.collect()} == brute(batches, 0.1)
    assert spark.conf.get(stateful.PROVIDER, "") != stateful.ROCKS


def test_a_lifecycle_that_is_forgotten_is_discovered_again(spark, tmp_path):
    kind = "key string, us long, status string, score double, flag string"
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for us in (1, 2):
        spark.createDataFrame([("a", us, "Filed", None, None)], kind).write.mode("append").parquet(folder)
        found = stateful.drained(stateful.lifecycles(spark.readStream.schema(kind).parquet(folder), keep_ms=1), "forgotten", state, clocked=True)
        time.sleep(0.2)
    assert sorted((r.us, r.event) for r in found.collect()) == [(1, "discovered"), (1, "status_changed"), (2, "discovered"), (2, "status_changed")]
