"""Work that must not grow with the square of a group, or stand in one task."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, neighbours, selection
from tidemark.plans import series  # noqa: F401  (it registers its queries)
from tidemark.plans.base import QUERIES


def test_fan_out_deals_its_pairs_over_tasks(spark, tmp_path):
    kinds = list(selection.PREFERENCE)
    events = spark.createDataFrame([(i, kinds[i % 4], ("India", "United States")[i % 3 % 2]) for i in range(300)] + [(7, "score", "India")], "event long, kind string, country string").coalesce(1)
    people = [(i, ("india", "us", "both", None)[i % 4], i % 2 == 0, i % 5 < 3, None if i % 7 else True) for i in range(150)] + [(3, "us", True, True, True)]
    leads = spark.createDataFrame(people, "lead long, markets string, wants_recommendation boolean, wants_score boolean, wants_flag boolean")
    for name, df in (("events", events), ("leads", leads)):  # few and small files, whose join is a broadcast
        df.coalesce(1).write.parquet(str(tmp_path / name))
    made = selection.fan_out(*(spark.read.parquet(str(tmp_path / name)) for name in ("events", "leads")))
    want = []
    for e, kind, country in events.collect():
        for lead, markets, *wants in people:
            if (markets not in ("india", "us") or (markets == "india") == (country == "India")) and wants[{"recommendation": 0, "red_flag": 2}.get(kind, 1)]:
                want.append((e, lead, kind))
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert made.groupBy(F.spark_partition_id()).count().count() > 1


def test_forward_asof_joins_take_no_frame_that_is_read_anew_for_every_row(spark):
    events = spark.range(3000).select((F.col("id") % 2).alias("key"), F.col("id").cast("int").alias("at"))
    bars = events.filter("at % 7 < 2").select("key", F.col("at").alias("t"), (F.col("at") * 10).alias("v"))
    bars.createOrReplaceTempView("growth_bars")
    events.createOrReplaceTempView("growth_events")
    want = spark.sql("SELECT e.key, e.at, min(b.v) FROM growth_events e LEFT JOIN growth_bars b ON b.key = e.key AND b.t >= e.at GROUP BY 1, 2")
    for span in (None, 100):
        got = asof.asof(events, bars, ["key"], "at", "t", ["v"], forward=True, span=span).select("key", "at", "v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    days = spark.sql("SELECT date_add(DATE '2024-01-01', cast(id * 3 AS int)) AS day, id AS v FROM range(50)")
    asked = spark.sql("SELECT date_add(DATE '2024-01-01', cast(id AS int) - 2) AS at FROM range(160)")
    on = asof.on_calendar(asked, days, "at", "day", "v", "out", forward=True)
    assert [r["out"] for r in on.orderBy("at").collect()] == [None if i > 149 else max(0, -(-(i - 2) // 3)) for i in range(160)]
    assert "unboundedfollowing" not in on._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("name", ["forward_return_windows", "benchmark_relative_12m"])
def test_return_windows_read_a_key_once(spark, name):
    made = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "unboundedfollowing" not in made._jdf.queryExecution().toString().lower()


def test_rows_with_equal_values_are_searched_once(spark, monkeypatch):
    rng = random.Random(8)
    kinds = [(g, *(rng.choice([None, 1.0, 2.0, 3.0]) for _ in "abc")) for g in ("g", "h") for _ in range(12)]
    rows = [(i, *kinds[i % len(kinds)]) for i in rng.sample(range(2000), 600)]
    df = spark.createDataFrame(rows, "id long, grp string, a double, b double, c double").repartition(5)
    asked = df.filter("id % 3 = 0")
    searched, blocks = [], neighbours._blocks

    def seen(t, id_col):
        searched.append(t.count())
        return blocks(t, id_col)

    monkeypatch.setattr(neighbours, "_blocks", seen)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    got = defaultdict(list)
    for r in neighbours.nearest(asked, df, ["a", "b", "c"], ["grp"], "id", k=4).orderBy("target", "nth").collect():
        got[r["target"]].append((r["nth"], r["neighbour"], r["dims"], round(r["adjusted"], 8)))
    z = {}
    for g in ("g", "h"):
        mine = [r for r in rows if r[1] == g]
        stats = [(sum(v) / len(v), math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) or 1.0) for v in ([r[j] for r in mine if r[j] is not None] for j in (2, 3, 4))]
        z |= {r[0]: (g, [None if x is None else (x - m) / s for x, (m, s) in zip(r[2:], stats, strict=True)]) for r in mine}
    want = {}
    for t in (i for i in z if i % 3 == 0):
        found = []
        for c in z:
            both = [(x - y) ** 2 for x, y in zip(z[t][1], z[c][1], strict=True) if x is not None and y is not None]
            if c != t and z[c][0] == z[t][0] and len(both) >= 2:
                far = math.sqrt(sum(both) / len(both)) * (1 + 0.25 * (sum(x is not None for x in z[t][1]) - len(both)))
                if far <= 2:
                    found.append((round(far, 9), -len(both), c))
        want[t] = [(n, c, -d, round(far, 8)) for n, (far, d, c) in enumerate(sorted(found)[:4], 1)]
    assert {t: got.get(t, []) for t in want} == want and set(got) <= set(want)
    assert searched[0] <= len(set(kinds))


def test_similarity_of_many_equal_rows_sends_few(spark, monkeypatch):
    df = spark.range(1000).select("id", F.lit("g").alias("grp"), (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2 * 3).cast("double").alias("b"), F.col("id").cast("double").alias("v"))
    held, best = [], neighbours._best

    def seen(candidates, *a):
        held.append(candidates.count())
        return best(candidates, *a)

    monkeypatch.setattr(neighbours, "_best", seen)
    got = neighbours.summary(neighbours.nearest(df.filter("id % 20 = 0"), df, ["a", "b"], ["grp"], "id"), df, "id", "v").collect()
    want = {t: [c for c in range(0, 20, 2) if c != t][:8] for t in range(0, 1000, 20)}
    assert {r["target"]: (r["n"], r["mean"], r["median"]) for r in got} == {t: (8, sum(c) / 8, c[4]) for t, c in want.items()}
    assert held == [2]
