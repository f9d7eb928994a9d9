import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, metrics, neighbours, ranked, resolve, summaries, timeline, walkforward

DAY = dt.date(2024, 1, 4)


def bars(spark, rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=d), o, c) for k, d, o, c in rows], "key string, day date, open double, close double")


def issues(spark, *rows):
    return spark.createDataFrame([(i, k, DAY + dt.timedelta(days=d), p) for i, (k, d, p) in enumerate(rows)], "id long, key string, listed date, price double")


def returns(spark, issue, rows):
    got = asof.forward_returns(issues(spark, issue), bars(spark, rows), "key").collect()
    return got[0].asDict() if got else None


def test_a_window_is_absent_until_it_has_elapsed(spark):
    three = [("a", 0, 100.0, 110.0), ("a", 1, 1.0, 120.0), ("a", 4, 1.0, 130.0)]
    r = returns(spark, ("a", 0, 100.0), three)
    assert r["listing_return"] == pytest.approx(10) and r["return_7d"] is None
    r = returns(spark, ("a", 0, 100.0), [*three, ("a", 7, 1.0, 140.0)])
    assert r["return_7d"] == pytest.approx(40) and r["return_30d"] is None and r["since_listing"] == pytest.approx(40)


def test_which_bar_is_the_session(spark):
    rows = [("a", d, 1.0, 10.0 + d) for d in range(0, 40)]
    assert returns(spark, ("a", 3, None), rows)["session_day"] == DAY  # the first bar, up to four days before
    assert returns(spark, ("a", 10, None), rows)["session_day"] == DAY + dt.timedelta(days=10)
    assert returns(spark, ("a", -14, None), rows)["session_day"] == DAY
    assert returns(spark, ("a", -15, None), rows) is None  # history starts too late
    assert returns(spark, ("b", 0, None), rows) is None


def test_beyond_belief_is_suppressed(spark):
    r = returns(spark, ("a", 0, 1.0), [("a", 0, 50.0, 100.0), ("a", 7, 1.0, 110.0)])
    assert r["listing_return"] is None and not r["from_offer"] and r["return_7d"] == pytest.approx(10)


def test_splits_adjust_the_offer(spark):
    i = issues(spark, ("a", 0, 100.0)).withColumn("splits", F.array(F.struct(F.lit(DAY + dt.timedelta(days=3)).alias("day"), F.lit(30.0).alias("factor"))))
    r = asof.forward_returns(i, bars(spark, [("a", 0, 1.0, 3300.0), ("a", 9, 1.0, 3000.0)]), "key", splits="splits").first()
    assert r["listing_return"] == pytest.approx(10) and r["since_listing"] == pytest.approx(0)


def test_pruned_series_give_the_same_returns(spark):
    rng = random.Random(3)
    rows = [(k, d, 10 + rng.random(), 10 + rng.random()) for k in "abc" for d in range(0, 1200) if rng.random() < 0.7]
    i = issues(spark, ("a", 0, 9.0), ("b", 30, None), ("c", 400, 11.0))
    b = bars(spark, rows)
    last = DAY + dt.timedelta(days=1199)
    kept = b.join(i.select("key", "listed"), "key").filter(asof.readable(F.col("day"), F.col("listed"), F.lit(last))).select(b.columns)
    windows = ["return_30d", "return_90d", "return_6m", "return_12m", "return_24m", "return_7d"]
    one, two = (asof.forward_returns(i, x.filter(F.col("day") >= DAY), "key").orderBy("id").select("id", *windows).collect() for x in (b, kept))
    assert kept.count() < b.count() / 2
    assert one[0] == two[0]


def test_asof_edges(spark):
    b = spark.createDataFrame([("k", 1, 10.0), ("k", 5, 50.0), ("k", 5, 55.0), ("k", 9, 90.0)], "key string, t int, v double")
    e = spark.createDataFrame([("k", x) for x in (0, 1, 4, 5, 6, 10)] + [("none", 5)], "key string, at int")
    run = lambda **k: {(r["key"], r["at"]): r["v"] for r in asof.asof(e, b, ["key"], "at", "t", ["v"], **k).collect()}
    assert run() == {("k", 0): None, ("k", 1): 10.0, ("k", 4): 10.0, ("k", 5): 55.0, ("k", 6): 55.0, ("k", 10): 90.0, ("none", 5): None}
    assert run(strict=True)["k", 5] == 10.0 and run(strict=True)["k", 1] is None
    assert run(forward=True) == {("k", 0): 10.0, ("k", 1): 10.0, ("k", 4): 55.0, ("k", 5): 55.0, ("k", 6): 90.0, ("k", 10): None, ("none", 5): None}
    assert run(forward=True, strict=True)["k", 5] == 90.0
    assert run(most=F.lit(2))["k", 4] is None and run(most=F.lit(3))["k", 4] == 10.0


def test_only_known_rules_are_believed(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    obs = spark.createDataFrame([(1, d(0), d(1), "prospectus_filing", 1.0), (1, d(2), d(9), "prospectus_filing", 2.0), (1, d(3), d(4), "hearsay", 3.0), (1, d(4), d(99), "first_periodic_report", 4.0), (1, d(5), d(5), "nse_live_feed", None)], "id long, period_end date, available_at date, rule string, value double")
    e = spark.createDataFrame([(1, d(5)), (1, d(9)), (1, d(0)), (2, d(9))], "id long, at date")
    run = lambda research: {(r["id"], r["at"]): r["value"] for r in asof.known_at(e, obs, ["id"], "at", research=research).collect()}
    assert run(False) == {(1, d(5)): 1.0, (1, d(9)): 2.0, (1, d(0)): None, (2, d(9)): None}
    assert run(True)[1, d(5)] == 4.0


def test_what_comes_later_changes_no_regime(spark):
    rows = [("m", d, 1.0, 100 + math.sin(d)) for d in range(0, 120)]
    i = issues(spark, ("m", 100, None))
    one = asof.regime(i, bars(spark, rows[:100]), "key", "listed").first()
    two = asof.regime(i, bars(spark, rows[:100] + [("m", d, 1.0, 1.0) for d in range(100, 120)]), "key", "listed").first()
    assert one == two and one["market_vol_20d"] > 0
    stale = asof.regime(i, bars(spark, rows[:90]), "key", "listed").first()
    assert stale["market_return_60d"] is None and stale["market_vol_20d"] is None
    assert asof.regime(i, bars(spark, rows[85:100]), "key", "listed").first()["market_vol_20d"] is None


@pytest.mark.parametrize("seed", range(3))
def test_rank_auc_is_pairwise_auc(spark, seed):
    rng = random.Random(seed)
    pairs = [(float(rng.randrange(20)), rng.randrange(2)) for _ in range(150)]
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(pairs)], "id long, p double, y int")
    assert metrics.auc(df).first()["auc"] == pytest.approx(want)
    assert metrics.auc(df.filter("y = 1")).first()["auc"] is None
    low, high = metrics.bootstrap_auc(df, "id").first()
    assert low < want < high
    assert metrics.bootstrap_auc(df.limit(10), "id").first()["low"] is None


def test_running_totals_need_no_key(spark):
    df = spark.createDataFrame([(i, i % 7) for i in random.Random(1).sample(range(1000), 1000)], "i long, v long")
    got = {r["i"]: r["s"] for r in ranked.running_total(df, [], "i", "v", "s").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_training_recovers_a_signal_and_no_more(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, 2015 + i // 100, a if i % 9 else None, b, 1.0, int(a + rng.gauss(0, 0.7) > 0), rng.randrange(2)))
    df = spark.createDataFrame(rows, "id long, year int, f_a double, f_b double, f_const double, y int, coin int")
    out, folds = walkforward.walk_forward(df, ["f_a", "f_b", "f_const"], "y", "year")
    assert [f["fitted"] for f in folds] == [False] + [True] * 5
    assert metrics.auc(out).first()["auc"] > 0.85
    noise, _ = walkforward.walk_forward(df, ["f_a", "f_b"], "coin", "year")
    assert 0.4 < metrics.auc(noise.withColumn("y", F.col("coin"))).first()["auc"] < 0.6


def test_gate_tiers():
    good = metrics.release_gate({"n": 400, "auc": 0.7, "brier": 0.2, "ece": 0.03}, 0.24, [0.6, 0.7, 0.65], graded=60)
    assert good["screening"] and good["production"] and good["probability"]
    assert not metrics.release_gate({"n": 400, "auc": 0.7, "brier": 0.2, "ece": 0.03}, 0.24, [0.6, 0.7, 0.65], leakage_free=False)["production"]
    assert not metrics.release_gate({"n": 50, "auc": 0.7, "brier": 0.2}, 0.24, [0.6])["screening"]


def test_neighbours_by_brute_force(spark):
    rng = random.Random(6)
    names = ["a", "b", "c"]
    rows = [(i, "g", *[rng.gauss(0, 1) if rng.random() < 0.8 else None for _ in names]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, grp string, a double, b double, c double")
    got = {}
    for r in neighbours.nearest(df.filter("id < 20"), df, names, ["grp"], "id", k=5).collect():
        got.setdefault(r["target"], []).append((r["nth"], r["neighbour"]))
    stats = {}
    for j, n in enumerate(names, 2):
        v = [r[j] for r in rows if r[j] is not None]
        m = sum(v) / len(v)
        stats[j] = m, math.sqrt(sum((x - m) ** 2 for x in v) / len(v))
    z = {r[0]: [None if r[j] is None else (r[j] - stats[j][0]) / stats[j][1] for j in stats] for r in rows}
    for t in range(20):
        found = []
        for c in range(200):
            both = [(x - y) ** 2 for x, y in zip(z[t], z[c], strict=True) if x is not None and y is not None]
            if c != t and len(both) >= 2:
                d = math.sqrt(sum(both) / len(both)) * (1 + 0.25 * (sum(x is not None for x in z[t]) - len(both)))
                if d <= 2:
                    found.append((round(d, 9), -len(both), c))
        assert [n for _, n in sorted(got.get(t, []))] == [c for *_, c in sorted(found)[:5]]


def test_merging_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "A", "Listed", 5.0), (2, "B", "Open", None)], "id long, company string, status string, price double")
    new = spark.createDataFrame([(1, "", "Open", None), (2, "B2", "Listed", 7.0), (3, "C", "Filed", 1.0)], "id long, company string, status string, price double")
    once = resolve.merged(old, new, "id")
    want = [(1, "A", "Listed", 5.0), (2, "B2", "Listed", 7.0), (3, "C", "Filed", 1.0)]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, resolve.merged(once, new, "id").collect())) == want


def test_conflicts_of_one_source_are_none(spark):
    e = spark.createDataFrame([("x", "a", 100.0), ("x", "a", 200.0), ("y", "a", 100.0), ("y", "b", 103.9), ("z", "a", 2500.0), ("z", "b", 1800.0), ("z", "c", None)], "k string, s string, v double")
    assert [(r["k"], r["least"], r["greatest"]) for r in resolve.conflicts(e, ["k"], "s", "v").collect()] == [("z", 1800.0, 2500.0)]


def test_past_issues(spark):
    d = dt.date(2024, 3, 1)
    items = spark.createDataFrame([(1, "A", "a", d, None, 100.0, d), (2, "B", "b", None, 50.0, 100.0, d), (3, "C", "c", d, 98.0, 100.0, d), (4, "D", "d", d, None, 50.0, d), (5, "E", "e", d, None, 100.0, dt.date(2020, 1, 1)), (6, "F", "f", d, None, None, None)], "id long, symbol string, name_key string, closed date, price double, high double, listed_on date")
    past = spark.createDataFrame([("A", "a", d, 99.0, d), ("B", "b", d, 100.0, d), ("C", "zz", d, 98.2, d), ("D", "d", d, 100.0, d), ("E", "e", d, 99.0, d), ("E", "e", d, 99.0, d)][:5], "symbol string, name_key string, closed date, price double, listed_on date")
    got = {r["id"]: r["outcome"] for r in resolve.past_issue(items, past).collect()}
    assert got == {1: "filled", 2: "conflict", 3: "agrees", 4: "outside_band", 5: "follow_on", 6: "unmatched"}


def test_timeline_names_what_changed(spark):
    s = spark.createDataFrame([(1, 1, 50.0, {"g": 50.0, "h": 1.0}, {"a": "1", "b": "2"}, "WATCH", "v1", None), (1, 2, 57.0, {"g": 58.0, "h": 1.5}, {"a": "1", "c": "3"}, "INVEST", "v2", None)], "id long, ts long, overall double, pillars map<string,double>, features map<string,string>, recommendation string, version string, event string")
    one, two = timeline.timeline(s, "id", "ts", "ts").orderBy("ts").collect()
    assert one["delta"] is None and one["drivers"] is None
    assert two["delta"] == 7.0 and [d["pillar"] for d in two["drivers"]] == ["g"] and two["changed"] == ["b", "c"] and two["version_change"] == "v1 -> v2" and two["recommendation_change"] == "WATCH -> INVEST"


def test_ties_don_t_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 5, i // 10, i) for i in range(200)], "k long, ts long, id long")
    seen = set()
    for n in (1, 3, 16):
        seen.add(tuple(sorted(map(tuple, ranked.latest(df.repartition(n), ["k"], "ts", "id").collect()))))
    assert len(seen) == 1
    assert summaries.zero_filled(df.withColumn("w", F.lit("x")), "w", ["x", "y"]).orderBy("nth").collect()[1]["n"] == 0
