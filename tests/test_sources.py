import io
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import readers, sinks
from tidemark.streaming import live


def test_atom(spark):
    feed = """<feed><entry><title>S-1 - Acme &amp; Sons Inc (0001234567) (Filer)</title><link rel="alternate" href="https://x/1"/><updated>2024-05-06T10:00:00</updated></entry>
      <entry><title>10-K - Other (0000000001)</title><link href="https://x/2"/><updated>2024-05-06</updated></entry></feed>"""
    got = spark.range(1).select(F.inline(readers.atom(F.lit(feed), "S-1"))).collect()
    assert [tuple(r) for r in got] == [("Acme & Sons Inc", "0001234567", "2024-05-06", "https://x/1")]
    both = spark.createDataFrame([("ACME", "1", 2), ("Acme", "1", 1), ("B", "2", 3)], "company string, cik string, n int")
    assert sorted(r["n"] for r in readers.first_seen(both, "n").collect()) == [1, 3]


def test_daily_index(spark, tmp_path):
    p = tmp_path / "master.idx"
    p.write_text("Description\n---\n1|A CO|S-1|2024-01-02|edgar/1.txt\n2|B|10-K|2024-01-02|e\nbroken|line\n")
    assert [r["company"] for r in readers.daily_index(spark, str(p), ["S-1"]).collect()] == ["A CO"]
    assert spark.range(1).select(readers.index_name(F.to_date(F.lit("2024-05-06")))).first()[0] == "daily-index/2024/QTR2/master.20240506.idx"


def fact(val, end, filed, form="10-K", start=None):
    return {"val": val, "end": end, "filed": filed, "form": form, "start": start, "accn": filed}


def test_company_facts(spark):
    body = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact(5e6, "2022-12-31", "2023-03-01", start="2022-01-01"), fact(7e6, "2023-12-31", "2024-05-01", start="2023-01-01"), fact(9e6, "2023-12-31", "2024-09-01", start="2023-01-01"), fact(1e6, "2023-03-31", "2024-05-01", start="2023-01-01")]}}, "Sales": {"units": {"USD": [fact(1e6, "2025-12-31", "2026-01-01")]}}}}}
    raw = spark.createDataFrame([(1, json.dumps(body)), (2, "{not json")], "id long, j string")
    rows = readers.facts(raw, "id", "j").cache()
    assert rows.count() == 5
    assert readers.latest_fact(rows, "id", ["Revenues", "Sales"], "x").first()["x"] == 9.0
    assert readers.already_reporting(rows, "id").count() == 1
    (r,) = readers.annual_history(rows.withColumn("listed", F.to_date(F.lit("2024-01-15"))), "id", ["Revenues"], "listed").collect()
    assert (r["current_m"], r["previous_m"]) == (7.0, None)  # the filing of 2023 came before the listing


def test_category_table(spark):
    rows = [{"category": "Qualified Institutional Buyers(QIBs)", "noOfTime": "10.5", "srNo": "1"}, {"category": "Foreign QIBs", "noOfTime": "99", "srNo": "1(a)"}, {"category": "Non Institutional Investors", "noOfTime": "", "srNo": "2"}, {"category": "Retail Individual", "noOfTime": "2", "srNo": "3"}]
    got = readers.bid_categories(spark.createDataFrame([(1, json.dumps({"bidDetails": rows}))], "id long, j string"), "id", "j").first()
    assert (got["qib"], got["nii"], got["retail"]) == (10.5, None, 2.0)


def test_live_feed_in_any_envelope(spark):
    item = {"companyName": " Acme ", "symbol": "acme", "priceBandMin": "Rs.90", "priceBandMax": "100", "noOfSharesOffered": "1,000,000", "noOfSharesBid": "2500000", "marketLot": "15", "issueStartDate": "05-Mar-2024", "issueEndDate": "2024-03-07"}
    raw = spark.createDataFrame([(json.dumps([item]),), (json.dumps({"data": [item]}),), (json.dumps({"x": 1}),)], "j string")
    got = readers.live_issues(raw, "j").collect()
    assert len(got) == 2 and all((r["company"], r["symbol"], r["price_low"], r["total_sub"], r["lot_size"], str(r["opened"])) == ("Acme", "ACME", 90.0, 2.5, 15, "2024-03-05") for r in got)


def test_prices_of_either_layout(spark, tmp_path):
    new = "TradDt,ISIN,TckrSymb,SctySrs,OpnPric,ClsPric,Other\n2024-07-09,INE1,AAA,EQ,10,11,x\n2024-07-09,INE2,BBB,GS,10,11,x\n"
    old = "SYMBOL,SERIES,OPEN,CLOSE,TIMESTAMP,ISIN,\nCCC,SM,1,2,05-JAN-2024,INE3,\n"
    for name, body in (("a", new), ("b", old)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", body)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = sorted((r["symbol"], str(r["day"]), r["open"], r["close"], r["isin"]) for r in readers.price_zips(spark, str(tmp_path / "*.zip")).collect())
    assert got == [("AAA", "2024-07-09", 10.0, 11.0, "INE1"), ("CCC", "2024-01-05", 1.0, 2.0, "INE3")]


def test_master_headers(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("﻿SYMBOL, NAME_OF_COMPANY,SERIES, DATE OF LISTING, ISIN_NUMBER\naaa,Acme Ltd,EQ,06-MAY-2008,ine1\n,No Symbol,EQ,06-MAY-2008,ine2\n", encoding="utf-8")
    (r,) = readers.security_master(spark, str(p), "Mainboard", "list").collect()
    assert (r["symbol"], r["name"], str(r["listed_on"]), r["isin"], r["board"]) == ("AAA", "Acme Ltd", "2008-05-06", "INE1", "Mainboard")


def test_price_json_and_splits(spark):
    raw = spark.createDataFrame([(1, json.dumps({"timestamp": [86400, 172800, 259200], "open": [1.0, None, 3.0], "close": [2.0, None, 4.0]}), json.dumps({"splits": {"b": {"date": 864000, "numerator": 1, "denominator": 30}, "a": {"date": 86400, "numerator": 2, "denominator": 1}, "c": {"date": 5, "numerator": 0, "denominator": 1}}}), json.dumps({"quotes": [{"symbol": "X.BO", "quoteType": "EQUITY"}, {"symbol": "X.NS", "quoteType": "EQUITY"}]}))], "id long, p string, s string, q string")
    assert [(str(r["day"]), r["close"]) for r in readers.price_history(raw, "id", "p").collect()] == [("1970-01-02", 2.0), ("1970-01-04", 4.0)]
    assert [s["factor"] for s in readers.splits(raw, "id", "s").first()["splits"]] == [0.5, 30.0]
    assert readers.best_quote(raw, "id", "q", ".NS").first()["symbol"] == "X.NS"
    assert readers.allowed_fields(spark.createDataFrame([('[{"a":"1","b":"2"}]',)], "j string"), "j", {"a": "string"}).columns == ["a"]


def xlsx(rows):
    from xml.sax.saxutils import escape

    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    sheet = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Report"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_monthly_report(spark, tmp_path):
    (tmp_path / "r.xlsx").write_bytes(xlsx([["Monthly report"], [], ["Sr", "Name of the Issuer", "Issue Type", "Issue Size (cr)", "Fresh Issue", "Offer for Sale", "Issue Price"], ["1", "Acme Ltd", "IPO", "1,000", "250", "750", "100"], ["2", "", "IPO"]]))
    (tmp_path / "bad.xlsx").write_bytes(b"zip?")
    (r,) = readers.monthly_reports(spark, str(tmp_path / "*.xlsx")).collect()
    assert (r["company"], r["kind"], r["size_m"], r["fresh_pct"], r["ofs_pct"], r["price"]) == ("Acme Ltd", "IPO", 10000.0, 25.0, 75.0, "100")


def test_heads_and_documents(spark, tmp_path):
    (tmp_path / "f.txt").write_text("x" * 100)
    (r,) = readers.head(spark, str(tmp_path / "f.txt"), 10).collect()
    assert r["text"] == "x" * 10 and r["truncated"]
    assert spark.range(1).select(readers.first_document(F.lit("a</DOCUMENT>b</DOCUMENT>"))).first()[0] == "a"


def test_links(spark):
    html = '<p><a class="x" href="/f/a.zip">Past <b>issues</b></a><A HREF=https://y/b.ZIP?z>issues 2</A><a href="c.pdf">issues</a></p>'
    got = readers.archive_links(spark.createDataFrame([(html, "https://h.com/p/q")], "html string, base string"), "html", "base", "Issues", "zip").collect()
    assert [(r["url"], r["label"]) for r in got] == [("https://h.com/f/a.zip", "Past issues"), ("https://y/b.ZIP?z", "issues 2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a — b", "x@y.org"), (2, "ok", "")], "id long, t string, m string")
    sinks.json_tree(df.withColumn("part", F.lit("p")), str(tmp_path / "j"), ["part"])
    assert sorted(r["t"] for r in spark.read.json(str(tmp_path / "j")).collect()) == ["a, b", "ok"]
    assert sinks.checked_copy(df, str(tmp_path / "c")) == 2
    assert [(r["id"], r["kinds"]) for r in sinks.leaks(df, ["t", "m"]).collect()] == [(1, ["dash", "email"])]
    sinks.csv_export(df, str(tmp_path / "e"), "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2


def test_search_takes_signs_as_they_are(spark):
    df = spark.createDataFrame([("100% Pure",), ("100 Pure",), (None,)], "c string")
    assert text.search(df, "0% p", ["c"]).count() == 1


def test_snapshots_are_written_when_something_moved(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, 10.0), (1, 2, 10.05), (1, 3, 10.2), (2, 1, 5.0)], "k long, ts long, v double").coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("k long, ts long, v double").parquet(str(src))
    got = live.drained(live.snapshots(s, "k", "ts", "v", 0.1), "snaps", "append", str(tmp_path / "cp")).collect()
    assert sorted((r["k"], r["ts"]) for r in got) == [(1, 1), (1, 3), (2, 1)]


def test_limits_do_not_count_what_they_reject(spark, tmp_path):
    """Against a plain limiter that keeps a list of accepted times per key; files come in several batches."""
    import datetime
    import random

    rng, rows = random.Random(2), []
    start = datetime.datetime(2024, 1, 1)
    for i in range(300):
        rows.append((rng.randrange(4), start + datetime.timedelta(seconds=i * 7 + rng.random())))
    src = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], "k long, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("k long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = sorted((r["k"], r["ts"], r["rejected"]) for r in live.drained(live.limited(s, "ts", "k", 3, 60.0), "limits", "append", str(tmp_path / "cp")).collect())
    held, want = {}, []
    for k, t in rows:
        mine = held[k] = [x for x in held.get(k, []) if (t - x).total_seconds() < 60]
        want.append((k, t, len(mine) >= 3))
        if len(mine) < 3:
            mine.append(t)
    assert got == sorted(want) and any(r for *_, r in want)


def test_cycles_and_empty_streams(spark, tmp_path):
    assert live.due_jobs(0) == ["ingest", "performance", "history"] and live.due_jobs(4) == ["ingest", "performance"] and live.due_jobs(5) == ["ingest"]
    assert live.trigger(5) == {"processingTime": "60 seconds"} and live.trigger() == {"processingTime": "900 seconds"}
    (tmp_path / "none").mkdir()
    s = spark.readStream.schema("k long, ts timestamp, value double").parquet(str(tmp_path / "none"))
    assert live.drained(live.tumbling(s, "ts", ["k"]), "nothing", "complete", str(tmp_path / "c")).count() == 0


def test_feeds_of_open_and_upcoming_issues(spark):
    one = lambda rows: spark.createDataFrame([(json.dumps(rows),)], "j string")
    open_ = one({"total": 2, "live": [{"company": "Acme", "symbol": "acme", "issueType": "SME", "issuePrice": "Rs.90", "qib": "-", "hniSubscription": "3"}, {"companyName": "B", "symbol": "B", "issuePriceMin": "10", "capPrice": "12", "noOfTime": "1.5"}]})
    next_ = one([{"companyName": "ACME", "symbol": "ACME"}, {"companyName": "C", "symbol": "C", "industry": "Tea", "issuePrice": "Rs.5 to Rs.6"}, {"x": "no name"}])
    details = spark.createDataFrame([("acme", json.dumps({"bidDetails": [{"category": "Qualified Institutional Buyers", "noOfTime": "7", "srNo": "1"}]}))], "symbol string, j string")
    got = {r["company"]: r for r in readers.current_and_upcoming(open_, next_, details, "j").collect()}
    assert set(got) == {"Acme", "B", "C"}
    a, b, c = got["Acme"], got["B"], got["C"]
    assert (a["status"], a["board"], a["final_price"], a["qib_sub"], a["nii_sub"]) == ("Open", "SME", 90.0, 7.0, 3.0)
    assert (b["price_low"], b["price_high"], b["final_price"], b["total_sub"]) == (10.0, 12.0, None, 1.5)
    assert (c["status"], c["sector"], c["price_low"], c["price_high"], c["final_price"]) == ("Upcoming", "Tea", 5.0, 6.0, None)


def test_past_issues(spark):
    rows = [{"symbol": "aa", "company": " A ", "securityType": "EQ", "ipoEndDate": "05-MAR-2024", "listingDate": "12-MAR-2024", "issuePrice": "100", "priceRange": "Rs.95 to Rs.100"}, {"symbol": "n", "securityType": "N0"}, {"symbol": "", "securityType": "EQ"}]
    (r,) = readers.past_issues(spark.createDataFrame([(json.dumps({"data": rows}),)], "j string"), "j").collect()
    assert (r["symbol"], r["company"], str(r["closed"]), str(r["listed"]), r["final_price"], r["price_low"], r["security_type"]) == ("AA", "A", "2024-03-05", "2024-03-12", 100.0, 95.0, "EQ")
