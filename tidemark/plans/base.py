"""The registry of queries, and the frames that stand for issues, snapshots, bars and evidence in the driver's tables.

The expressions of ISSUE are plain SQL that Spark and DuckDB read alike, so that both sides start from the same rows; what
is then computed is written twice, once with the library and once as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Registers a query and the SQL that it is held against; days: date columns, which both give as ISO texts."""

    def add(f):
        QUERIES[f.__name__] = f if not days else lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in days})
        if sql:
            ORACLES[f.__name__] = sql if not days else f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({sql})"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pct(k: str, skip: int, base: float, mod: int, mul: int, scale: float = 1.0) -> str:
    """A number that depends on the key and is missing for some keys."""
    return f"CASE WHEN {k} % {skip} = 0 THEN NULL ELSE CAST({base} AS DOUBLE) + CAST(({k} * {mul}) % {mod} AS DOUBLE) * CAST({scale} AS DOUBLE) END"


K = "c_custkey"
ISSUE = {
    "id": K,
    "company": "c_name",
    "sector": "c_mktsegment",
    "country": "CASE WHEN n_regionkey % 2 = 0 THEN 'India' ELSE 'United States' END",
    "board": f"CASE WHEN {K} % 4 = 0 THEN 'SME' ELSE 'Mainboard' END",
    "status": f"CASE {K} % 7 WHEN 0 THEN 'Filed' WHEN 1 THEN 'Upcoming' WHEN 2 THEN 'Open' WHEN 3 THEN 'Closed' WHEN 4 THEN 'Not IPO' WHEN 5 THEN 'Withdrawn' ELSE 'Listed' END",
    "symbol": f"CASE WHEN {K} % 5 = 0 THEN '' ELSE 'S' || CAST({K} % 700 AS VARCHAR(10)) END",
    "filing_url": f"CASE {K} % 5 WHEN 0 THEN 'https://www.sec.gov/f/' || CAST({K} AS VARCHAR(10)) WHEN 1 THEN 'https://sec.gov.example.com/' WHEN 2 THEN '' WHEN 3 THEN 'https://www.nseindia.com/x?y=1' ELSE NULL END",
    "price_low": _pct(K, 13, 40, 300, 7),
    "price_high": _pct(K, 11, 50, 300, 7),
    "final_price": f"CASE WHEN {K} % 3 = 0 THEN NULL WHEN {K} % 10 = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(45 + ({K} * 7) % 310 AS DOUBLE) END",
    "issue_size_m": _pct(K, 17, 5, 900, 31),
    "shares_offered_m": _pct(K, 9, 1, 40, 3),
    "post_issue_shares_m": _pct(K, 8, 10, 90, 13),
    "revenue_m": _pct(K, 12, 20, 3000, 137),
    "revenue_prev_m": _pct(K, 10, 15, 2800, 131),
    "revenue_2y_ago_m": _pct(K, 6, 10, 2500, 127),
    "ebitda_m": _pct(K, 14, -60, 700, 53),
    "net_income_m": _pct(K, 15, -80, 400, 41),
    "cfo_m": _pct(K, 7, -70, 420, 43),
    "debt_m": _pct(K, 16, 0, 800, 29),
    "cash_m": _pct(K, 18, 0, 300, 23),
    "fresh_issue_pct": _pct(K, 19, 0, 100, 11),
    "ofs_pct": _pct(K, 20, 0, 100, 17),
    "promoter_retention_pct": _pct(K, 21, 20, 70, 3),
    "qib_sub": _pct(K, 5, 0, 1300, 3, 0.1),
    "nii_sub": _pct(K, 22, 0, 600, 7, 0.1),
    "retail_sub": _pct(K, 23, 0, 300, 11, 0.1),
    "total_sub": _pct(K, 24, 0, 1200, 5, 0.1),
    "gmp_pct": _pct(K, 4, -15, 70, 9),
    "underwriter_quality": _pct(K, 25, 0, 51, 1, 0.1),
    "anchor_quality": _pct(K, 26, 0, 51, 7, 0.1),
    "market_regime": _pct(K, 27, 0, 51, 11, 0.1),
    "sector_regime": _pct(K, 28, 0, 51, 13, 0.1),
    "dual_class": f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE {K} % 6 = 1 END",
    "peer_median_pe": _pct(K, 29, 5, 40, 3),
    "peer_median_ps": _pct(K, 30, 1, 12, 5),
    "lockup_days": f"CASE WHEN {K} % 31 = 0 THEN NULL ELSE CAST(30 + {K} % 200 AS INT) END",
    "market_overhang_pct": _pct(K, 33, 0, 80, 19),
    "age_days": f"CAST(({K} * 5) % 500 AS INT)",
    "conflicts": f"CAST({K} % 4 AS INT)",
    "n_data_flags": f"CAST({K} % 3 AS INT)",
    "balance": "c_acctbal",
}


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as issues. The nation table is a fixed list of 25, so it is broadcast."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    flags = F.slice(F.array(F.lit("flag a"), F.lit("flag b")), F.lit(1), F.col("n_data_flags"))
    return c.select(*[F.expr(sql).alias(name) for name, sql in ISSUE.items()]).withColumn("data_flags", flags)


ISSUES_SQL = "issues AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in ISSUE.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price bars: one per part brand and ship date; open and close from quantities and prices."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return li.groupBy((F.col("l_partkey") % 40).alias("key"), F.col("l_shipdate").cast("date").alias("day")).agg(F.floor(F.min(unit) * 100).alias("o"), F.floor(F.max(unit) * 100).alias("c")).select("key", "day", (F.col("o") / 100).alias("open"), (F.col("c") / 100).alias("close"))


BARS_SQL = "bars AS (SELECT l_partkey % 40 AS key, CAST(l_shipdate AS DATE) AS day, floor(min(l_extendedprice / l_quantity) * 100) / 100 AS open, floor(max(l_extendedprice / l_quantity) * 100) / 100 AS close FROM lineitem GROUP BY 1, 2)"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as issues that listed on some day."""
    p = table(spark, sf_dir, "part")
    day = F.date_add(F.to_date(F.lit("1996-01-01")), (F.col("p_partkey") % 1500).cast("int"))
    return p.select(F.col("p_partkey").alias("issue"), (F.col("p_partkey") % 40).alias("key"), day.alias("listed"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).alias("price"))


LISTINGS_SQL = "listings AS (SELECT p_partkey AS issue, p_partkey % 40 AS key, DATE '1996-01-01' + CAST(p_partkey % 1500 AS INT) AS listed, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS price FROM part)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence: part and ship year are the field, the supplier the source, the unit price the value."""
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("field"), (F.col("l_suppkey") % 5).alias("source"), unit.alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))


EVIDENCE_SQL = 'evidence AS (SELECT l_partkey AS entity, CAST(year(l_shipdate) AS INT) AS field, l_suppkey % 5 AS source, floor(l_extendedprice / l_quantity * 100) / 100 AS "value", l_orderkey * 10 + l_linenumber AS "row" FROM lineitem)'


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: p from the text's length, y from its quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), (F.least(F.floor(F.col("n_chars") / 40), F.lit(100))).cast("double").alias("p"), F.col("quality").cast("int").alias("y"), F.col("n_chars").cast("double").alias("size"), F.col("toxic").cast("int").alias("toxic"))


PAIRS_SQL = "pairs AS (SELECT doc_id AS id, CAST(least(floor(n_chars / 40), 100) AS DOUBLE) AS p, CAST(quality AS INT) AS y, CAST(n_chars AS DOUBLE) AS size, CAST(toxic AS INT) AS toxic FROM documents JOIN labels USING (doc_id))"


def r4(x: str) -> str:
    """SQL that rounds as steady(x, 4) does."""
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"
