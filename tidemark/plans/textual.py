"""Queries over texts, pages and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, prospectus, scoring, text
from tidemark.operators import timeline
from tidemark.plans.base import ISSUES_SQL, issues, query, table
from tidemark.sources import readers


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' 10:00:00' WHEN 2 THEN strftime(d, '%d-%b-%Y') WHEN 3 THEN upper(strftime(d, '%d-%b-%Y')) WHEN 4 THEN strftime(d, '%d/%m/%Y') WHEN 5 THEN strftime(d, '%Y%m%d') WHEN 6 THEN strftime(d, '%d-%m-%Y') ELSE 'soon' END AS raw, d FROM o)
    SELECT o_orderkey, CASE WHEN raw = 'soon' THEN NULL ELSE d END AS day, CASE WHEN raw = 'soon' THEN raw ELSE strftime(d, '%Y-%m-%d') END AS kept FROM s""", days=("day",))
def multi_format_date_parse(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    shapes = [day.cast("string"), F.concat(day.cast("string"), F.lit(" 10:00:00")), F.date_format(day, "dd-MMM-yyyy"), F.upper(F.date_format(day, "dd-MMM-yyyy")), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "dd-MM-yyyy"), F.lit("soon")]
    raw = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", dates.parsed(F.col("raw")).alias("day"), dates.keep_raw(F.col("raw")).alias("kept"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN o_totalprice END AS x FROM (SELECT o_orderkey, floor(o_totalprice) + 0.5e0 AS o_totalprice FROM orders)""")
def number_from_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.format_number(F.floor("o_totalprice") + 0.5, 1)
    shapes = F.array(F.concat(F.lit("Rs. "), t), F.concat(F.lit("("), t, F.lit(")")), F.concat(F.lit("₹ "), t), F.lit("-"))
    return table(spark, d, "orders").select("o_orderkey", text.number(F.element_at(shapes, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("x"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' Ltd.' WHEN 1 THEN upper(c_name) || ' PRIVATE LIMITED' WHEN 2 THEN c_name || ' (India) & Co' ELSE 'The Company Inc' END AS raw FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'the company inc' WHEN 2 THEN replace(lower(split_part(raw, ' (', 1)), '#', ' ') || ' and' ELSE replace(replace(replace(lower(raw), ' ltd.', ''), ' private limited', ''), '#', ' ') END AS name FROM n""")
def canonical_name(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    raw = F.element_at(F.array(F.concat(n, F.lit(" Ltd.")), F.concat(F.upper(n), F.lit(" PRIVATE LIMITED")), F.concat(n, F.lit(" (India) & Co")), F.lit("The Company Inc")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", text.canonical_name(raw).alias("name"))


@query(f"""WITH {ISSUES_SQL} SELECT id, coalesce(filing_url IN ('https://www.nseindia.com/x?y=1') OR starts_with(filing_url, 'https://www.sec.gov/'), false) AS is_primary FROM issues""")
def host_primary_source(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("id", scoring.primary_source(F.col("filing_url")).alias("is_primary"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))


def _kind_sql(kind: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{kind}' END"


@query(f"SELECT doc_id, concat_ws(',', {', '.join(_kind_sql(k, p) for k, p in sorted(text.SECRETS.items()))}) AS kinds FROM documents")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.findings(F.col("text")), ",").alias("kinds"))


#: What a cover may say, and the kind of offering that it then is of.
_COVERS = [
    ("This proxy statement/prospectus is sent to holders of {}.", "merger_proxy"),
    ("{} 5% notes. Per Note Total Public offering price (1) 99.50%", "debt_offering"),
    ("Shares of {} are sold in connection with our direct listing. Unlike an initial public offering, the resale is not underwritten.", "direct_listing"),
    ("Holders on the record date will get shares of {} in the spin-off.", "spin_off_distribution"),
    ("{}: the last reported sale price was $5.00 on Nasdaq. Since our initial public offering in 2019 we grew.", "follow_on"),
    ("This prospectus relates to the resale from time to time of 5 shares of {} by holders.", "resale_only"),
    ("{}: this is our initial public offering. The initial public offering price is $18.00 per share. We have applied to list under the symbol &#147;FWRG&#148;.", "ipo"),
    ("Since our initial public offering {} grew.", "unknown"),
]
_KINDS = " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_COVERS))


@query(f"""SELECT c_custkey, CASE c_custkey % {len(_COVERS)} {_KINDS} END AS kind, CASE WHEN c_custkey % {len(_COVERS)} = 6 THEN 18.0e0 END AS price, CASE WHEN c_custkey % {len(_COVERS)} = 6 THEN 'FWRG' END AS symbol FROM customer""")
def offering_type(spark: SparkSession, d: str) -> DataFrame:
    covers = F.array(*[F.concat(*[x for i, part in enumerate(c.split("{}")) for x in ([F.col("c_name")] if i else []) + [F.lit(part)]]) for c, _ in _COVERS])
    c = table(spark, d, "customer").select("c_custkey", F.element_at(covers, (F.col("c_custkey") % len(_COVERS) + 1).cast("int")).alias("t"))
    return prospectus.read(c, "t").select("c_custkey", "kind", F.col("final_price").alias("price"), "symbol")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, 'licensed under') THEN 'licence' WHEN regexp_matches(t, '@[a-z0-9.-]+') AND NOT regexp_matches(t, ' the ') THEN 'contact' WHEN regexp_matches(t, ' (der|die|das) ') THEN 'german' ELSE 'unknown' END AS kind FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def doc_classifier(spark: SparkSession, d: str) -> DataFrame:
    rules = [("licence", ["licensed under"], []), ("contact", ["@[a-z0-9.-]+"], [" the "]), ("german", [" (der|die|das) "], [])]
    return table(spark, d, "documents").select("doc_id", text.classify(F.lower("text"), rules).alias("kind"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1) AS u FROM pages) SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS nth FROM a""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.posexplode(text.links(F.col("html"))).alias("i", "l"))
    return p.select("page_id", "l.url", (F.col("i") + 1).cast("long").alias("nth"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS val, CAST(json_extract(props, '$.k') AS DOUBLE) / 1e6 AS latest_m FROM events")
def xbrl_json_flatten(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"facts":{"us-gaap":{"Revenues":{"units":{"USD":[{"val":'), F.get_json_object("props", "$.k"), F.lit(',"end":"2024-01-01","filed":"2024-02-01","form":"10-K"}]}}}}}')).alias("j"))
    f = readers.facts(e, "event_id", "j")
    return f.join(readers.latest_fact(f, "event_id", ["Revenues"], "latest_m"), "event_id").select("event_id", F.col("val").cast("long").alias("val"), "latest_m")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), j AS (SELECT b.event_id, b.event_type <> a.event_type AS t, json_extract_string(a.props, '$.k') <> json_extract_string(b.props, '$.k') AS k FROM e a JOIN e b ON a.user_id = b.user_id AND b.n = a.n + 1)
    SELECT event_id, concat_ws(',', CASE WHEN k THEN 'k' END, CASE WHEN t THEN 'type' END) AS changed FROM j""")
def json_map_diff(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.ranked import with_previous

    e = table(spark, d, "events").withColumn("m", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"))))
    return with_previous(e, ["user_id"], "ts", "event_id", ["m"]).filter("nth > 1").select("event_id", F.array_join(timeline.changed_keys(F.col("prev_m"), F.col("m")), ",").alias("changed"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.5e0 * (event_id % 10) END AS qib, CASE WHEN event_id % 2 = 0 THEN 2.0e0 END AS nii, CAST(event_id % 7 AS DOUBLE) AS retail FROM events""")
def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    row = lambda name, value, nr: F.concat(F.lit(f'{{"category":"{name}","srNo":"{nr}","noOfTime":"'), value.cast("string"), F.lit('"}'))
    k = F.col("event_id")
    parts = F.array_compact(F.array(F.when(k % 3 == 0, row("Qualified Institutional Buyers", (k % 10) * 1.5, "1")), row("Foreign part of QIBs", F.lit(99), "1(a)"), F.when(k % 2 == 0, row("Non Institutional Investors", F.lit(2.0), "2")), row("Retail Individual Investors", k % 7, "3")))
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"bidDetails":['), F.array_join(parts, ","), F.lit("]}")).alias("j"))
    return readers.bid_categories(e, "event_id", "j")


@query("SELECT o_orderkey, 'Rs.' || CAST(o_totalprice AS INT) || ' to Rs.' || (CAST(o_totalprice AS INT) + 5) AS raw, CAST(CAST(o_totalprice AS INT) AS DOUBLE) AS low, CAST(CAST(o_totalprice AS INT) + 5 AS DOUBLE) AS high FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def price_band_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("int")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Rs."), n.cast("string"), F.lit(" to Rs."), (n + 5).cast("string")).alias("raw"))
    b = text.price_band(F.col("raw"))
    return o.select("o_orderkey", "raw", b["low"].alias("low"), b["high"].alias("high"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SME IPO' WHEN 1 THEN 'IPO' WHEN 2 THEN 'InvIT IPO' WHEN 3 THEN 'REIT IPO' END AS kind, CASE p_partkey % 6 WHEN 0 THEN 'SME' WHEN 5 THEN 'SME' ELSE 'Mainboard' END AS board FROM part")
def issue_type_classifier(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    raw, ex = F.element_at(F.array(*map(F.lit, ("NSE SME", "Main  ipo", "InvIT-IPO", "reit ipo", "Rights", "QIP"))), at), F.element_at(F.array(*map(F.lit, ("", "", "", "", "", "NSE Emerge"))), at)
    p = table(spark, d, "part").select("p_partkey", raw.alias("raw"), ex.alias("ex"))
    return p.select("p_partkey", text.issue_type(F.col("raw")).alias("kind"), text.board(text.issue_type(F.col("raw")), F.col("ex")).alias("board"))
