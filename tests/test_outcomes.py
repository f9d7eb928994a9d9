"""Late outcomes against brute force, over batches that come out of order, restarts and retries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import outcomes

DAY = dt.datetime(2024, 1, 1)
FAR = DAY + dt.timedelta(days=4000)


def hour(n):
    return DAY + dt.timedelta(hours=n)


@pytest.fixture
def sides(spark, tmp_path):
    """Two folders of batches, and the streams that read them a file at a time."""
    kinds = {"predictions": "id long, key string, due timestamp", "prices": "key string, at timestamp, price double"}

    def put(side, rows):
        spark.createDataFrame(rows, kinds[side]).coalesce(1).write.mode("append").parquet(str(tmp_path / side))

    def stream(side):
        return lambda: spark.readStream.schema(kinds[side]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / side))

    return put, stream("predictions"), stream("prices"), str(tmp_path / "state")


def brute(predictions, prices, within, after, attempts):
    out = {}
    for i, key, due in predictions:
        for n in range(1, attempts + 1):
            d = due + (n - 1) * after
            hits = [(at, p) for k, at, p in prices if k == key and d <= at <= d + within]
            out[i] = (due, *(min(hits) if hits else (None, None)), n)
            if hits:
                break
    return out


def test_outcomes_of_batches_out_of_order(spark, sides):
    put, predictions, prices, folder = sides
    rng = random.Random(4)
    asked = [(i, rng.choice("abc"), hour(rng.randrange(200))) for i in range(60)]
    seen = [(rng.choice("abc"), hour(rng.randrange(400)), float(rng.randrange(100))) for _ in range(60)]
    for rows, side in ((asked, "predictions"), (seen, "prices")):
        rows = rng.sample(rows, len(rows))
        for a in range(0, 60, 20):
            put(side, rows[a : a + 20])
    put("predictions", [(-1, "end", FAR)])
    put("prices", [("end", FAR, 0.0)])
    run = lambda: outcomes.settled(predictions(), prices(), "10 HOURS", 3, "50 HOURS", "400 hours", folder)
    want = brute(asked, seen, dt.timedelta(hours=10), dt.timedelta(hours=50), 3)
    got = {r.id: (r.due, r["at"], r.price, r.attempt) for r in run().filter("id >= 0").collect()}
    assert got == want and {r[3] for r in want.values()} == {1, 2, 3}
    assert {r.id for r in run().filter(F.col("category") == outcomes.BLOCKED).collect()} == {i for i, r in want.items() if r[1] is None}


def test_what_waits_is_settled_by_a_later_run(spark, sides):
    put, predictions, prices, folder = sides
    put("predictions", [(1, "a", hour(1)), (2, "a", hour(100)), (3, None, hour(1)), (4, "a", None), (1, "a", hour(1))])
    put("prices", [("a", hour(2), 5.0), ("a", hour(2), 4.0), ("a", None, 1.0), ("b", hour(60), None)])
    run = lambda: {(r.id, r.category, r["at"], r.price) for r in outcomes.settled(predictions(), prices(), "10 HOURS", 1, late="1 hour", checkpoint=folder).collect()}
    assert run() == set()  # nothing has passed
    put("prices", [("b", hour(300), 7.0)])
    put("predictions", [(5, "b", hour(300))])
    assert run() == {(1, "GRADED", hour(2), 4.0), (2, outcomes.BLOCKED, None, None), (3, outcomes.BLOCKED, None, None)}
    put("prices", [("b", hour(900), 7.0)])
    put("predictions", [(6, "b", hour(900))])
    assert (5, "GRADED", hour(300), 7.0) in run()
