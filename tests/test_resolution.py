"""Resolution against masters, series and ledgers, names, and small rules: each over matches, misses, ties and nulls."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import dates, text, valuation
from tidemark.operators import ledger, resolve, walkforward


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_equity_of_another_instrument(spark):
    master = spark.createDataFrame([("a", "INE123A01016", "A"), ("b", "INE999B01011", "B"), ("b", "INE999B01012", "B2"), ("", "INE000C01019", "C")], "name_key string, isin string, symbol string")
    items = spark.createDataFrame([(1, "a", "INE123A07018"), (2, "a", "INE123A01016"), (3, "a", "INE124A07018"), (4, "b", "INE999B07011"), (5, "", "INE000C07019"), (6, "a", "short"), (7, None, None)], "id long, name_key string, isin string")
    assert {r.id: r.equity_isin for r in resolve.equity_of(items, master).collect()} == {1: "INE123A01016", 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_symbols_held_against_the_master(spark):
    master = spark.createDataFrame([("i1", "Abc"), ("i1", "XYZ"), ("i1", "abc"), ("i2", None), (None, "N")], "isin string, symbol string")
    items = spark.createDataFrame([(1, "i1", "ABC"), (2, "i1", "q"), (3, "i2", "a"), (4, "i9", "a"), (5, None, "n"), (6, "i1", None)], "id long, isin string, symbol string")
    assert {r.id: r.agrees for r in resolve.symbol_agrees(items, master).collect()} == {1: True, 2: False, 3: False, 4: None, 5: None, 6: None}


def test_what_to_do_with_a_symbol(spark):
    master = spark.createDataFrame([("INE1A0000001", "a", "AAA"), ("INE2B0000001", "b", "BBB"), ("INE3C0000001", "c", "C1"), ("INE3C0000001", "c", "C2")], "isin string, name_key string, symbol string")
    items = spark.createDataFrame([(1, "INE1A0000001", "a", "aaa"), (2, "INE1A0000001", "a", "OLD"), (3, "INE3C0000001", "c", "C1"), (4, None, "zzz", "Z"), (5, "INE2B0000009", "b", None)], "id long, isin string, name_key string, symbol string")
    got = {r.id: (r.outcome, r.master_symbol, r.action) for r in ledger.reconciled(items, master).collect()}
    assert got == {1: ("RESOLVED_ISIN", "AAA", "keep"), 2: ("RESOLVED_ISIN", "AAA", "adopt"), 3: ("AMBIGUOUS", None, "ask"), 4: ("UNRESOLVED", None, "keep"), 5: ("NAME_ISIN_PREFIX", "BBB", "adopt")}


def test_the_first_candidate_that_a_series_has(spark):
    items = spark.createDataFrame([(1, ["X-SM.NS", "X.NS", "X.BO"]), (2, ["Y.NS"]), (3, []), (4, None)], "id long, c array<string>")
    series = spark.createDataFrame([("X.BO",), ("X.NS",), ("X.NS",), (None,)], "symbol string")
    assert {r.id: r.series_key for r in resolve.first_found(items, series, "c", "symbol", "id").collect()} == {1: "X.NS", 2: None, 3: None, 4: None}


def test_flags_of_a_prefix_are_replaced(spark):
    flags = F.array(F.lit("price: old"), F.lit("other"), F.lit("price: older"))
    assert one(spark, resolve.unchanged(flags, "price:", F.lit("price: new")), resolve.unchanged(flags, "price:", F.lit(None).cast("string"))) == (["other", "price: new"], ["other"])


def test_days_that_a_ledger_lacks(spark):
    have = spark.createDataFrame([("2024-01-02",), ("2024-01-02",), ("2024-01-06",), (None,)], "d string").select(F.to_date("d").alias("day"))
    assert sorted(str(r.day) for r in dates.missing_days(have, "day", "2024-01-01", "2024-01-08").collect()) == ["2024-01-01", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08"]


def test_names_and_texts(spark):
    names = {"Adani Green": False, "  ": True, None: True, "* as on date": True, "note: x": True, "Notebook Ltd": False, "Company  Name": True, "Company": False, "TOTAL": True, "123 - 4": True}
    rows = spark.createDataFrame([(n, w) for n, w in names.items()], "n string, want boolean")
    assert rows.filter(text.artefact_name(F.col("n")) != F.col("want")).count() == 0
    assert one(spark, *[text.spac_name(F.lit(x).cast("string")) for x in ("Big Acquisition Corp", "Acquisitions Ltd", "The SPAC", None)]) == (True, False, True, False)
    assert one(spark, text.is_registration(F.lit("an Initial Public Offering")), text.is_registration(F.lit("a sale"))) == (True, False)
    assert one(spark, *[text.board(F.lit(k).cast("string"), F.lit(e).cast("string")) for k, e in (("SME IPO", None), ("IPO", "NSE Emerge"), ("IPO", "BSE SME"), ("IPO", "NSE"), ("IPO", None))]) == ("SME", "SME", "SME", "Mainboard", "Mainboard")
    assert one(spark, text.one_line(F.lit(" a\r\nb\n\nc ")), text.header_key(F.lit("Issue Size\n(Rs. cr)"))) == ("a b c", "issuesizerscr")
    df = spark.createDataFrame([("x", 1)], "`Company Name` string, `No. of Shares` long")
    assert df.transform(text.by_header, {"companyname": "company", "noofshares": "shares", "isin": "isin"}).first().asDict() == {"company": "x", "shares": 1, "isin": None}


def test_inputs_that_are_missing_and_targets(spark):
    df = spark.createDataFrame([(0.0, None, 5.0)], "a double, b double, c double")
    assert df.select(valuation.missing_inputs(x=["a", "b"], y=["b", "c"], z=["b"]).alias("m")).first().m == ["a or b", "b"]
    rows = spark.createDataFrame([(1.0, None, None), (None, 5.0, 4.0), (None, 4.0, 5.0), (None, None, 1.0), (0.0, 9.0, 1.0)], "r double, o double, b double")
    assert [r.t for r in rows.select(walkforward.relative_target(F.col("r"), F.col("o"), F.col("b")).alias("t")).collect()] == [1, 1, 0, None, 0]


def test_a_heartbeat_keeps_what_was_not_touched(spark):
    at = lambda h: F.lit(dt.datetime(2024, 1, 1, h)).cast("timestamp")
    first = ledger.beat(spark.createDataFrame([], "name string, beat_at timestamp, cycle_at timestamp, performance_at timestamp, history_at timestamp"), "w", at(1), ("cycle", "history"))
    second = ledger.beat(first, "w", at(2), ("cycle",)).first()
    assert [second[c] and second[c].hour for c in ("beat_at", "cycle_at", "performance_at", "history_at")] == [2, 2, None, 1]


def test_observations_of_a_day(spark):
    stored = spark.createDataFrame([(1, "sub", "2024-01-01", 1.0, "open"), (1, "gmp", "2024-01-02", 9.0, "open")], "id long, field string, day string, value double, stage string")
    live = spark.createDataFrame([(1, 2.0, None), (1, 3.0, None), (2, None, 4.0)], "id long, sub double, gmp double")
    got = ledger.observed_on(live, stored, ["sub", "gmp"], F.lit("2024-01-02"), F.lit("day 2"))
    assert sorted(map(tuple, got.collect())) == [(1, "gmp", "2024-01-02", 9.0, "open"), (1, "sub", "2024-01-01", 1.0, "open"), (1, "sub", "2024-01-02", 3.0, "day 2"), (2, "gmp", "2024-01-02", 4.0, "day 2")]


def test_a_digest_has_so_many_of_each_section(spark):
    movers = spark.createDataFrame([(1, 2.0), (2, -5.0), (3, 0.5)], "id long, delta double")
    newest = spark.createDataFrame([(4, "New Co", "2024-01-02"), (5, "Newer Co", "2024-01-03")], "id long, company string, seen_at string")
    flags = spark.createDataFrame([(6, "debt")], "id long, code string")
    got = sorted((r.section, r.nth, r.id, r.text) for r in ledger.digest(movers, newest, flags, 2).collect())
    assert got == [("flags", 1, 6, "debt"), ("movers", 1, 2, "-5.0"), ("movers", 2, 1, "+2.0"), ("new", 1, 5, "Newer Co"), ("new", 2, 4, "New Co")]
