"""The merging sink: repeated and broken batches, equality with one build of everything, conflicts by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import merge


def observed(rng, n):
    return [(str(rng.randrange(9)), rng.choice("fg"), rng.choice(["2022", "2023"]), rng.choice("xyz"), rng.randrange(1, 3), rng.choice([None, 100.0, 103.0, 105.0, 0.0, -1.0]), rng.randrange(30)) for _ in range(n)]


@pytest.fixture
def batches(spark):
    rng = random.Random(8)
    rows = [observed(rng, 40) for _ in range(3)] + [[(None, "f", "2023", "x", 1, 1.0, 1), ("1", None, "2023", "x", 1, 1.0, 1)]]
    return [spark.createDataFrame(r, merge.OBSERVED) for r in rows], [x for r in rows for x in r]


def held(table):
    return sorted(map(tuple, table.observations().collect()))


def test_broken_and_repeated_batches_change_nothing(spark, batches, tmp_path, monkeypatch):
    frames, rows = batches
    once = merge.MergedTable(spark, str(tmp_path / "once"), 4)
    for i, df in enumerate(frames):
        once.write_batch(df, i)
    table = merge.MergedTable(spark, str(tmp_path / "often"), 4)
    table.write_batch(frames[0], 0)
    table.write_batch(frames[0], 0)
    before = held(table)
    with monkeypatch.context() as m:  # the driver dies between the rows and the commit
        real = spark.createDataFrame
        m.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **kw: (_ for _ in ()).throw(RuntimeError("killed")) if schema == "bucket int" else real(data, schema, **kw))
        with pytest.raises(RuntimeError, match="killed"):
            table.write_batch(frames[1], 1)
    assert held(table) == before
    for i in (1, 1, 2, 2, 3, 1):  # a batch long done may come again, too
        table.write_batch(frames[i], i)
    latest, first = {}, {}
    for *key, tier, value, seq in rows:
        if value is not None and None not in key:
            latest[tuple(key)] = max(latest.get(tuple(key), ()), (seq, value, tier))
            first[tuple(key)] = min(first.get(tuple(key), seq), seq)
    assert held(once) == sorted((*k, tier, value, seq, first[k]) for k, (seq, value, tier) in latest.items())


def test_a_batch_rewrites_only_what_it_touches(spark, batches, tmp_path):
    import os

    table = merge.MergedTable(spark, str(tmp_path), 16)
    table.write_batch(batches[0][0], 0)
    one = batches[0][1].filter("id = '1'")
    table.write_batch(one, 1)
    assert len([p for p in os.listdir(tmp_path / "rows" / "batch=1") if p.startswith("bucket=")]) == 1
    assert table.observations().filter("id <> '1'").count() == batches[0][0].filter("id <> '1' and value is not null").select(*merge.KEYS).distinct().count()


def test_provenance_conflicts_and_filling(spark, tmp_path):
    table = merge.MergedTable(spark, str(tmp_path), 2)
    rows = [("1", "f", "2022", "x", 1, 50.0, 1), ("1", "f", "2023", "x", 1, 100.0, 1), ("1", "f", "2023", "y", 2, 103.0, 2), ("1", "f", "2023", "z", 2, 105.0, 9), ("2", "f", "2023", "x", 2, 7.0, 1), ("2", "f", "2022", "y", 1, 8.0, 1), ("3", "f", "2023", "x", 1, 0.0, 1), ("3", "f", "2023", "y", 1, 0.0, 1)]
    table.write_batch(spark.createDataFrame(rows, merge.OBSERVED), 0)
    got = {(r.id, r.source): (r.value, r.conflict) for r in table.provenance().collect()}
    assert got == {("1", "x"): (100.0, True), ("1", "y"): (103.0, False), ("1", "z"): (105.0, True), ("2", "x"): (7.0, True), ("2", "y"): (8.0, True), ("3", "x"): (0.0, False), ("3", "y"): (0.0, False)}
    issues = spark.createDataFrame([("1", None, "a"), ("2", 3.0, "b"), ("9", None, "c"), ("2", None, "d")], "id string, f double, name string")
    assert {(r.id, r.f, r.name) for r in table.filled(issues, ["f"]).collect()} == {("1", 100.0, "a"), ("2", 3.0, "b"), ("9", None, "c"), ("2", 8.0, "d")}


def test_a_stream_gives_what_one_batch_gives(spark, batches, tmp_path):
    frames, _ = batches
    table, whole = merge.MergedTable(spark, str(tmp_path / "t"), 4), merge.MergedTable(spark, str(tmp_path / "w"), 4)
    folder = str(tmp_path / "in")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(merge.OBSERVED).parquet(folder)
        merge.merge_stream(stream, table, str(tmp_path / "state"))
    whole.write_batch(spark.read.schema(merge.OBSERVED).parquet(folder), 0)
    assert held(table) == held(whole) and merge.MergedTable(spark, str(tmp_path / "none")).observations().count() == 0
    assert table.provenance().filter("conflict").count() == whole.provenance().filter(F.col("conflict")).count() > 0
