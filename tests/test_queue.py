"""The queue against a simulation of one message at a time, with sends that fail, quotas, and cycles that die."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import queue as q

HOUR, DAY = 3600, 86_400


def outcome(i, attempts):
    """Whether a message goes through at an attempt, and whether it may be tried again."""
    return (i * 7 + attempts * 3) % 5 > 1, i % 3 != 1


def send(tried):
    x = (F.col("id") * 7 + F.col("attempts") * 3) % 5
    return tried.select("id", (x > 1).alias("ok"), (F.col("id") % 3 != 1).alias("retryable"))


def simulated(state, new, people, now, limit, daily, monthly, day, month):
    for m in new:
        state.setdefault(m[0], {"id": m[0], "recipient": m[1], "template": m[2], "priority": m[3], "queued_at": m[4], "status": q.QUEUED, "attempts": 0, "tried_at": None, "sent_at": None})
    had = lambda since: sum(m["status"] == q.SENT and m["sent_at"] >= since for m in state.values())
    room, taken = min(daily - had(day), monthly - had(month)), 0
    for m in sorted(state.values(), key=lambda m: (m["priority"], m["queued_at"], m["id"])):
        if m["status"] != q.QUEUED or (m["attempts"] and now - m["tried_at"] < min(3600, 30 * 2 ** m["attempts"])):
            continue
        suppressed, consent = people.get(m["recipient"], (True, False))
        if suppressed or (m["template"] != "welcome" and not consent):
            m["status"] = q.SUPPRESSED if suppressed else q.UNSUBSCRIBED
            continue
        if taken >= limit or (m["priority"] > 1 and room <= 0):
            continue
        taken, room = taken + 1, room - (m["priority"] > 1)
        ok, again = outcome(m["id"], m["attempts"])
        m["attempts"], m["tried_at"] = m["attempts"] + 1, now
        if ok:
            m["status"], m["sent_at"] = q.SENT, now
        elif not again or m["attempts"] >= q.MOST_ATTEMPTS:
            m["status"] = q.FAILED
    return state


def test_cycles_are_those_of_a_simulation(spark, tmp_path):
    rng = random.Random(6)
    people = {p: (p == "x", p in "ab") for p in "abcx"}
    recipients = spark.createDataFrame([(p, s, c) for p, (s, c) in people.items()], "recipient string, suppressed boolean, consent boolean")
    kind = "id long, recipient string, template string, priority int, queued_at long"
    table, state, ids = q.Queue(spark, str(tmp_path), send, 6, 12, 20), {}, iter(range(1000))
    fields = [f.split()[0] for f in q.MESSAGES.split(", ")]
    for cycle, now in enumerate((DAY, DAY + 40, DAY + 100, DAY + 2 * HOUR, 2 * DAY + 5), 1):
        new = [(next(ids), rng.choice("aabbcxz"), rng.choice(["welcome", "news"]), rng.randrange(1, 4), now - rng.randrange(50)) for _ in range(8)]
        state = simulated(state, new, people, now, 6, 12, 20, now // DAY * DAY, 0)
        frame = spark.createDataFrame(new, kind)
        assert table.run(cycle, now, frame.union(frame), recipients, now // DAY * DAY, 0)
        assert not table.run(cycle, now + 999, frame, recipients, 0, 0)
        assert sorted(map(tuple, table.messages().select(*fields).collect())) == sorted(tuple(m[f] for f in fields) for m in state.values())
    assert {m["status"] for m in state.values()} == {q.QUEUED, q.SENT, q.FAILED, q.SUPPRESSED, q.UNSUBSCRIBED}
    with pytest.raises(ValueError, match="cycle 9 after 5"):
        table.run(9, 0, frame, recipients, 0, 0)


def test_a_cycle_that_dies_is_done_again(spark, tmp_path):
    def dies(tried):
        raise RuntimeError("killed")

    recipients = spark.createDataFrame([("a", False, True)], "recipient string, suppressed boolean, consent boolean")
    new = spark.createDataFrame([(1, "a", "news", 2, 0), (2, "a", "news", 1, 5)], "id long, recipient string, template string, priority int, queued_at long")
    with pytest.raises(RuntimeError):
        q.Queue(spark, str(tmp_path), dies).run(1, 100, new, recipients, 0, 0)
    table = q.Queue(spark, str(tmp_path), send, 1)
    assert table.messages().count() == 0 and table.run(1, 100, new, recipients, 0, 0)
    assert {(r.id, r.status, r.attempts) for r in table.messages().collect()} == {(1, "QUEUED", 0), (2, "SENT", 1)}


def test_waits_double_up_to_an_hour(spark):
    rows = spark.createDataFrame([(0, None), (1, 100), (1, 99), (6, 0), (9, 0), (40, 0)], "attempts int, tried_at long")
    got = [r.w for r in rows.select(q.waits(F.col("attempts"), F.col("tried_at"), 159).alias("w")).collect()]
    assert got == [False, True, False, True, True, True]
    assert [r.w for r in rows.select(q.waits(F.col("attempts"), F.col("tried_at"), 3600).alias("w")).collect()][3:] == [False, False, False]
