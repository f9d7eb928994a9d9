"""Files in the shapes that filings, exchanges and price feeds come in, as typed frames."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import parsed
from tidemark.functions.text import absolute, links, number, price_band, strip_tags

#: Fixed: series of shares that are kept of a daily price file.
SERIES = ("EQ", "BE", "SM", "ST")
PERIODIC_FORMS = ("10-K", "10-Q", "20-F", "40-F")
FACTS = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<val:double,start:string,end:string,filed:string,form:string,accn:string,fy:int,fp:string>>>>>>>"


def atom(feed: Column, form: str) -> Column:
    """array<struct<company, cik, filed, url>> of an Atom feed's entries whose title begins with a form."""
    entries = F.regexp_extract_all(feed, F.lit(r"(?s)<entry>(.*?)</entry>"), 1)
    tag = lambda e, p: strip_tags(F.regexp_extract(e, p, 1))
    title = lambda e: tag(e, r"(?s)<title[^>]*>(.*?)</title>")
    shape = rf"(?i)^{re.escape(form)}(?:/A)?\s*-\s*(.*?)\s*\((\d{{4,10}})\)"
    own = F.filter(entries, lambda e: title(e).rlike(shape))
    return F.transform(own, lambda e: F.struct(F.regexp_extract(title(e), shape, 1).alias("company"), F.regexp_extract(title(e), shape, 2).alias("cik"), F.substring(tag(e, r"(?s)<updated>(.*?)</updated>"), 1, 10).alias("filed"), F.regexp_extract(e, r"""<link[^>]*href=["']([^"']+)""", 1).alias("url")))


def first_seen(feeds: DataFrame, order: str) -> DataFrame:
    """Entries of several feeds, each (company in any case, cik) once: the first in order."""
    key = F.lower("company")
    best = feeds.groupBy(key.alias("_k"), "cik").agg(F.min_by(F.struct(*feeds.columns), order).alias("_r"))
    return best.select("_r.*")


def daily_index(spark: SparkSession, path: str, forms: list[str]) -> DataFrame:
    """A pipe-separated daily index: cik, company, form, filed, file; lines of fewer than five parts are none."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).filter(F.size(parts) >= 5).select(*[F.trim(parts[i]).alias(n) for i, n in enumerate(("cik", "company", "form", "filed", "file"))]).filter(F.col("form").isin(*forms))


def index_name(day: Column) -> Column:
    return F.concat(F.lit("daily-index/"), F.year(day).cast("string"), F.lit("/QTR"), F.quarter(day).cast("string"), F.lit("/master."), F.date_format(day, "yyyyMMdd"), F.lit(".idx"))


def facts(raw: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Company facts as rows: id, taxonomy, concept, unit, val, start, end, filed, form, accn. JSON that can't be read gives none."""
    j = raw.select(id_col, F.from_json(json_col, FACTS).alias("j"))
    a = j.select(id_col, F.explode("j.facts").alias("taxonomy", "concepts"))
    b = a.select(id_col, "taxonomy", F.explode("concepts").alias("concept", "c"))
    c = b.select(id_col, "taxonomy", "concept", F.explode("c.units").alias("unit", "rows"))
    return c.select(id_col, "taxonomy", "concept", "unit", F.inline("rows"))


def latest_fact(rows: DataFrame, id_col: str, concepts: list[str], out: str) -> DataFrame:
    """The value of the fact filed last (then of the last period), in millions, of the first concept that has any."""
    rank = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    own = rows.filter(F.col("concept").isin(*concepts) & F.col("val").isNotNull()).withColumn("_rank", rank)
    return own.groupBy(id_col).agg((F.max_by("val", F.struct(-F.col("_rank"), "filed", "end")) / 1e6).alias(out))


def already_reporting(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.filter(F.col("form").isin(*PERIODIC_FORMS)).select(id_col).distinct()


def annual_history(rows: DataFrame, id_col: str, concepts: list[str], listed: str) -> DataFrame:
    """current, previous and before that: values of the last three yearly periods that ended by listing and were filed
    within 18 months after it; of a period, what was filed first counts."""
    end, start, filed = (F.try_to_date(c) for c in ("end", "start", "filed"))
    ok = rows.filter(F.col("concept").isin(*concepts)).withColumns({"_e": end, "_s": start, "_f": filed})
    ok = ok.filter((F.datediff("_e", "_s").between(350, 380)) & (F.col("_e") <= F.col(listed)) & F.col("_f").between(F.col(listed), F.add_months(F.col(listed), 18)))
    per = ok.groupBy(id_col, "_e").agg(F.min_by("val", F.struct("_f", "accn")).alias("v"))
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("_e", "v")))), 1, 3)
    got = per.groupBy(id_col).agg(last.alias("l"))
    nth = lambda i: (F.try_element_at("l", F.lit(i))["v"] / 1e6)
    return got.select(id_col, nth(1).alias("current_m"), nth(2).alias("previous_m"), nth(3).alias("before_m"))


def bid_categories(raw: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """qib, nii and retail subscription of an offer's category table; sub-rows such as 1(a) are passed over."""
    kind = "struct<bidDetails:array<struct<category:string,noOfTime:string,srNo:string>>>"
    rows = raw.select(id_col, F.posexplode(F.from_json(json_col, kind)["bidDetails"]).alias("pos", "b"))
    c = F.lower("b.category")
    cat = F.when(c.contains("qualified institutional") | c.contains("qib"), "qib").when(c.contains("non institutional") | c.contains("non-institutional"), "nii").when(c.contains("retail"), "retail")
    own = rows.filter(~F.coalesce(F.col("b.srNo"), F.lit("")).contains("(")).withColumns({"cat": cat, "x": number(F.col("b.noOfTime"))}).filter("cat is not null and x is not null")
    return own.groupBy(id_col).pivot("cat", ["qib", "nii", "retail"]).agg(F.min_by("x", "pos"))


# Fixed: what a live feed calls each field, best name first.
FEED_NAMES = {
    "company": ("companyName", "company", "issuerName", "name", "symbol"),
    "symbol": ("symbol", "issueSymbol"),
    "isin": ("isin",),
    "kind": ("issueType", "series", "board", "category"),
    "sector": ("industry", "sector"),
    "price_low": ("issuePriceMin", "priceBandMin", "minPrice", "floorPrice"),
    "price_high": ("issuePriceMax", "priceBandMax", "maxPrice", "capPrice"),
    "band": ("issuePrice",),
    "offered": ("noOfSharesOffered", "sharesOffered", "issueSize"),
    "bid": ("noOfsharesBid", "noOfSharesBid", "sharesBid"),
    "total_sub": ("noOfTime", "subscription", "totalSubscription"),
    "qib_sub": ("qibSubscription", "qib", "qibSub", "qibNoOfTime"),
    "nii_sub": ("niiSubscription", "hniSubscription", "nii", "niiSub", "niiNoOfTime"),
    "retail_sub": ("retailSubscription", "retail", "retailSub", "retailNoOfTime"),
    "lot": ("marketLot", "lotSize", "minimumBidQuantity"),
    "opened": ("issueStartDate", "openDate", "ipoStartDate"),
    "closed": ("issueEndDate", "closeDate", "ipoEndDate"),
    "listed": ("listingDate",),
    "status": ("status",),
}
ENVELOPES = ("data", "records", "issues", "result", "results", "rows")
#: Fixed: kinds of security that past issues are taken of.
EQUITY_KINDS = ("EQ", "BE", "SME", "SM", "ST")


def feed_rows(raw: DataFrame, json_col: str) -> DataFrame:
    """A row (entry: map of texts) for each object of a feed's list, whatever envelope the list stands in: the text itself, a
    known name, or else all lists of objects that it has."""
    body, rows = F.col(json_col), "array<map<string,string>>"
    named = [F.from_json(F.get_json_object(body, f"$.{k}"), rows) for k in ENVELOPES]
    lists = F.filter(F.map_values(F.from_json(body, "map<string,string>")), lambda v: F.ltrim(v).startswith("["))
    others = F.flatten(F.array_compact(F.transform(lists, lambda v: F.from_json(v, rows))))
    is_list = F.ltrim(body).startswith("[")
    found = F.when(is_list, F.from_json(body, rows)).otherwise(F.coalesce(*named, others))
    return raw.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("entry"))


def _named(field: str) -> Column:
    """The first name's value that isn't blank or a dash."""
    return F.coalesce(*[F.when(~F.trim(F.coalesce(v, F.lit(""))).isin("", "-", "--"), F.trim(v)) for v in (F.col("entry")[n] for n in FEED_NAMES[field])])


def live_issues(raw: DataFrame, json_col: str, status: str = "Upcoming") -> DataFrame:
    """Issues of a live feed: names, board, prices, sizes, subscription and days. A single price is a fixed price: the final
    one. Subscription is as told, else shares bid over shares offered."""
    r = feed_rows(raw, json_col).select(*[_named(f).alias(f) for f in FEED_NAMES]).filter("company is not null")
    offered, band = number(F.col("offered")), price_band(F.col("band"))
    stated = F.col("price_low").isNotNull() | F.col("price_high").isNotNull()
    single = ~stated & band["low"].isNotNull() & (band["low"] == band["high"])
    kind = F.lower(F.coalesce("kind", F.lit("")))
    return r.select(
        "company", F.upper("symbol").alias("symbol"), F.coalesce("isin", F.lit("")).alias("isin"), F.when(kind.contains("sme") | kind.contains("emerge"), "SME").otherwise("Mainboard").alias("board"), F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce(number(F.col("price_low")), band["low"]).alias("price_low"), F.coalesce(number(F.col("price_high")), band["high"]).alias("price_high"), F.when(single, band["low"]).alias("final_price"),
        F.when(offered > 100_000, offered / 1e6).otherwise(offered).alias("shares_offered_m"), F.coalesce(number(F.col("total_sub")), F.try_divide(number(F.col("bid")), offered)).alias("total_sub"),
        *[number(F.col(c)).alias(c) for c in ("qib_sub", "nii_sub", "retail_sub")], F.nullif(number(F.col("lot")).cast("int"), F.lit(0)).alias("lot_size"),
        parsed(F.col("opened")).alias("opened"), parsed(F.col("closed")).alias("closed"), F.coalesce("status", F.lit(status)).alias("status"),
    )


def current_and_upcoming(current: DataFrame, upcoming: DataFrame, details: DataFrame, json_col: str) -> DataFrame:
    """Open issues and upcoming ones as one table, an issue (company and symbol, whatever their case) where it comes first.
    Open ones take their categories from details (symbol, and the category table under json_col) where these have them."""
    both = live_issues(current, json_col, "Open").withColumns({"status": F.lit("Open"), "_o": F.lit(0)}).unionByName(live_issues(upcoming, json_col).withColumns({"status": F.lit("Upcoming"), "_o": F.lit(1)}))
    best = both.groupBy(F.lower("company").alias("_c"), F.lower(F.coalesce("symbol", F.lit(""))).alias("_s")).agg(F.min_by(F.struct(*both.columns), F.struct("_o", F.xxhash64(*both.columns))).alias("r")).select("r.*").drop("_o")
    cats = bid_categories(details.select(F.upper("symbol").alias("_symbol"), json_col), "_symbol", json_col)
    j = best.join(cats, (F.col("symbol") == F.col("_symbol")) & (F.col("status") == "Open"), "left")
    return j.withColumns({f"{c}_sub": F.coalesce(c, f"{c}_sub") for c in ("qib", "nii", "retail")}).select(*best.columns)


def past_issues(raw: DataFrame, json_col: str) -> DataFrame:
    """Final prices and days of past equity issues; other instruments and rows without a symbol are left out."""
    r = feed_rows(raw, json_col)
    get = lambda k: F.trim(F.coalesce(F.col("entry")[k], F.lit("")))
    band = price_band(get("priceRange"))
    kind = F.upper(get("securityType"))
    return r.filter((get("symbol") != "") & kind.isin(*EQUITY_KINDS)).select(
        F.upper(get("symbol")).alias("symbol"), F.coalesce(_named("company"), F.lit("")).alias("company"), parsed(get("ipoEndDate")).alias("closed"), parsed(get("ipoStartDate")).alias("opened"), parsed(get("listingDate")).alias("listed"),
        number(get("issuePrice")).alias("final_price"), band["low"].alias("price_low"), band["high"].alias("price_high"), kind.alias("security_type"),
    )


def archive_links(pages: DataFrame, html_col: str, base_col: str, label: str, extension: str) -> DataFrame:
    """Absolute links of pages whose label holds a word and whose path has an extension."""
    found = pages.select("*", F.inline(links(F.col(html_col))))
    return found.filter(F.lower("label").contains(label.lower()) & F.lower("url").rlike(rf"\.{extension}(?:[?#]|$)")).withColumn("url", absolute(F.col("url"), F.col(base_col)))


PRICES = "path string, symbol string, series string, day date, open double, close double, isin string"


def price_zips(spark: SparkSession, glob: str) -> DataFrame:
    """Bars of zipped daily price files of either layout; a bad zip gives no rows, and so do series that aren't kept."""

    def unzip(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                        for n in names[:1]:
                            raw = pd.read_csv(z.open(n), dtype=str, index_col=False)
                            raw.columns = [c.strip() for c in raw.columns]
                            yield pd.DataFrame({"path": path, **{k: raw.get(new, raw.get(old)) for k, new, old in _LAYOUTS}})
                except (zipfile.BadZipFile, ValueError):
                    continue

    text = "path string, symbol string, series string, day string, open string, close string, isin string"
    rows = spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(unzip, text)
    return rows.select("path", F.trim("symbol").alias("symbol"), F.trim("series").alias("series"), parsed(F.col("day")).alias("day"), number(F.col("open")).alias("open"), number(F.col("close")).alias("close"), F.trim("isin").alias("isin")).filter(F.col("series").isin(*SERIES) & F.col("close").isNotNull())


# Fixed: what the new and the old layout call each column.
_LAYOUTS = (("symbol", "TckrSymb", "SYMBOL"), ("series", "SctySrs", "SERIES"), ("day", "TradDt", "TIMESTAMP"), ("open", "OpnPric", "OPEN"), ("close", "ClsPric", "CLOSE"), ("isin", "ISIN", "ISIN"))


def security_master(spark: SparkSession, path: str, board: str, source: str) -> DataFrame:
    """A master list whose header may be spelled with blanks or underscores and begin with a byte order mark."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[re.sub(r"[\s_]+", " ", c.replace("﻿", "")).strip().upper() for c in df.columns])
    get = lambda *names: next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))
    rows = df.select(F.upper(F.trim(get("SYMBOL"))).alias("symbol"), F.trim(get("NAME OF COMPANY", "COMPANY NAME")).alias("name"), F.trim(get("SERIES")).alias("series"), parsed(get("DATE OF LISTING")).alias("listed_on"), F.upper(F.trim(get("ISIN NUMBER", "ISIN"))).alias("isin"))
    return rows.withColumns({"board": F.lit(board), "source": F.lit(source)}).filter(F.coalesce("symbol", F.lit("")) != "")


def price_history(raw: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Bars of parallel arrays of times, opens and closes; those without a close are left out."""
    j = F.from_json(json_col, "struct<timestamp:array<long>,open:array<double>,close:array<double>>")
    z = raw.select(id_col, F.inline(F.arrays_zip(j["timestamp"].alias("ts"), j["open"].alias("open"), j["close"].alias("close"))))
    z = z.toDF(id_col, "ts", "open", "close")
    return z.filter("close is not null").withColumn("day", F.to_date(F.timestamp_seconds("ts")))


def splits(raw: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """array<struct<day, factor>> of split events, by day; factor is denominator over numerator."""
    events = F.map_values(F.from_json(json_col, "struct<splits:map<string,struct<date:long,numerator:double,denominator:double>>>")["splits"])
    good = F.filter(events, lambda e: (e["numerator"] > 0) & (e["denominator"] > 0) & e["date"].isNotNull())
    return raw.select(id_col, F.array_sort(F.transform(good, lambda e: F.struct(F.to_date(F.timestamp_seconds(e["date"])).alias("day"), (e["denominator"] / e["numerator"]).alias("factor")))).alias("splits"))


def best_quote(raw: DataFrame, id_col: str, json_col: str, suffix: str | None) -> DataFrame:
    """The symbol of the first share among search results, with a suffix if one is asked for."""
    quotes = F.from_json(json_col, "struct<quotes:array<struct<symbol:string,quoteType:string>>>")["quotes"]
    ok = F.filter(quotes, lambda q: (F.coalesce(q["symbol"], F.lit("")) != "") & (F.coalesce(q["quoteType"], F.lit("EQUITY")) == "EQUITY") & (q["symbol"].endswith(suffix) if suffix else F.lit(True)))
    return raw.select(id_col, F.try_element_at(ok, F.lit(1))["symbol"].alias("symbol"))


def allowed_fields(raw: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """Only fields that a licence allows, of each object of a JSON list."""
    return raw.select(F.inline(F.from_json(json_col, "array<struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">>")))


def first_document(raw: Column) -> Column:
    return F.substring_index(raw, "</DOCUMENT>", 1)


def head(spark: SparkSession, glob: str, most: int) -> DataFrame:
    """The first bytes of files as text, and whether there was more."""
    b = spark.read.format("binaryFile").load(glob)
    return b.select("path", F.decode(F.substring("content", 1, most), "UTF-8").alias("text"), (F.col("length") > most).alias("truncated"))


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of an XLSX file's sheets."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for title, name in zip(titles, files, strict=False):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{main}row"):
                cells: list[str] = []
                for c in row.iter(f"{main}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = c.find(f"{main}v")
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "") or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                rows.append(cells)
            out.append((title, rows))
    return out


REPORT = "path string, sheet string, company string, kind string, size_m double, fresh_pct double, ofs_pct double, price string, listed string, isin string"
# Fixed: words of a header by which a report's columns are known.
HEADERS = {"company": ("company", "name of the issuer"), "kind": ("issue type", "type of issue"), "size_m": ("issue size",), "fresh_pct": ("fresh",), "ofs_pct": ("offer for sale", "ofs"), "price": ("price",), "listed": ("listing date", "date of listing"), "isin": ("isin",)}


def monthly_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of monthly XLSX reports. The header is the first of a sheet's 25 top rows that names a company and an issue
    type; crores become millions; shares of fresh issue and offer for sale are percentages of the size, 0 to 100."""

    def value(text: str) -> float | None:
        try:
            return float(re.sub(r"[,\s₹]", "", text or ""))
        except ValueError:
            return None

    def read(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    book = sheets(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for sheet, rows in book:
                    top = next((i for i, r in enumerate(rows[:25]) if {"company", "kind"} <= {k for k, ws in HEADERS.items() if any(w in c.lower() for c in r for w in ws)}), None)
                    if top is None:
                        continue
                    at = {k: next((i for i, c in enumerate(rows[top]) if any(w in c.lower() for w in ws)), None) for k, ws in HEADERS.items()}
                    for r in rows[top + 1 :]:
                        got = {k: r[i].strip() if i is not None and i < len(r) else "" for k, i in at.items()}
                        size = value(got["size_m"])
                        share = lambda k, got=got, size=size: max(0.0, min(100.0, value(got[k]) / size * 100)) if size and value(got[k]) is not None else None
                        if got["company"]:
                            out.append((path, sheet, got["company"], got["kind"], size * 10 if size is not None else None, share("fresh_pct"), share("ofs_pct"), got["price"], got["listed"], got["isin"]))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in REPORT.split(", ")])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(read, REPORT)
