"""Queries over facts, observations and evidence that are read from events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filings, resolve
from tidemark.plans.base import query, table

#: Events as facts of companies: plain SQL that both engines read alike. Some facts have the wrong unit, length or taxonomy.
_CONCEPTS = ["Revenues", "SalesRevenueNet", "NetIncomeLoss", "ProfitLoss", "OperatingIncomeLoss", "DepreciationAndAmortization", "NetCashProvidedByUsedInOperatingActivities", "CashAndCashEquivalents", "LongTermDebtCurrent", "LongTermDebtNoncurrent", "LongTermDebt", "EntityCommonStockSharesOutstanding", "OtherAssets"]
_YEARLY = "event_id % 13 < 7"
_END = "(2019 + event_id // 13 % 5)"
_CONCEPT = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CONCEPTS)) + " END"
FACTS_SQL = f"""facts AS (SELECT user_id AS id, {_CONCEPT} AS concept, CAST("value" AS DOUBLE) * 1000000 AS val,
    CASE WHEN event_id % 13 = 11 THEN 'dei' WHEN event_id % 7 = 3 THEN 'ifrs-full' ELSE 'us-gaap' END AS taxonomy,
    CASE WHEN event_id % 13 = 11 THEN 'shares' WHEN event_id % 19 = 0 THEN 'EUR' ELSE 'USD' END AS unit,
    CASE WHEN {_YEARLY} THEN CAST({_END} AS VARCHAR(4)) || CASE WHEN event_id % 17 = 0 THEN '-07-01' ELSE '-01-01' END END AS "start",
    CAST({_END} AS VARCHAR(4)) || CASE WHEN event_id % 13 = 7 AND event_id % 5 = 0 THEN '-09-30' ELSE '-12-31' END AS "end",
    CAST(2024 + event_id // 65 % 2 AS VARCHAR(4)) || '-0' || CAST(1 + event_id // 130 % 9 AS VARCHAR(1)) || '-15' AS filed,
    '10-K' AS form, 'a' || CAST(event_id % 100 AS VARCHAR(2)) || '-' || CAST(event_id AS VARCHAR(12)) AS accn FROM events)"""
LISTED_SQL = "listed AS (SELECT DISTINCT user_id AS id, CAST(2023 + user_id % 2 AS VARCHAR(4)) || '-11-20' AS listed FROM events WHERE user_id % 10 > 0)"

_RANKS = {c: i for concepts in (*filings.YEARLY.values(), *filings.AT_A_DAY.values()) for i, c in enumerate(concepts)}
_LINES = {c: line for line, concepts in {**filings.YEARLY, **filings.AT_A_DAY}.items() for c in concepts}
_LINE = "CASE concept " + " ".join(f"WHEN '{c}' THEN '{line}'" for c, line in _LINES.items()) + " END"
_RANK = "CASE concept " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in _RANKS.items()) + " END"
_SINCE = "(year(CAST(filed AS DATE)) - year(CAST(listed AS DATE))) * 12 + month(CAST(filed AS DATE)) - month(CAST(listed AS DATE)) BETWEEN 0 AND 18"
_YEARS = "('revenue', 'net_income', 'cfo', 'operating_income', 'd_and_a')"


def _nth(field: str, line: str, nth: int) -> str:
    return f"SELECT id, '{field}' AS field, val / 1000000 AS v, \"end\", \"start\", filed, accn, concept FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"end\" DESC) AS nth FROM best WHERE line = '{line}') WHERE nth = {nth}"


def _sum(field: str, a: str, b: str, order: str) -> str:
    return f"""SELECT id, '{field}' AS field, v, "end", "start", filed, accn, concept FROM (SELECT a.id, (a.val + b.val) / 1000000 AS v, a."end", a."start", a.filed, a.accn, a.concept || '+' || b.concept AS concept, row_number() OVER (PARTITION BY a.id ORDER BY {order} a."end" DESC) AS nth
        FROM best AS a JOIN best AS b ON a.id = b.id AND a."end" = b."end" AND a.line = '{a}' AND b.line = '{b}' LEFT JOIN closes AS c ON c.id = a.id AND c."end" = a."end") WHERE nth = 1"""


def _balance(field: str, line: str) -> str:
    return f"""SELECT id, '{field}' AS field, v, "end", "start", filed, accn, concept FROM (SELECT a.*, val / 1000000 AS v, row_number() OVER (PARTITION BY a.id ORDER BY c.id IS NULL, a."end" DESC) AS nth FROM best AS a LEFT JOIN closes AS c ON c.id = a.id AND c."end" = a."end" WHERE line = '{line}') WHERE nth = 1"""


STATEMENT_SQL = f"""WITH {FACTS_SQL}, {LISTED_SQL},
    lined AS (SELECT facts.*, listed, {_LINE} AS line, {_RANK} AS rank FROM facts JOIN listed USING (id) WHERE val IS NOT NULL),
    own AS (SELECT *, max(taxonomy) OVER (PARTITION BY id, line) AS first_taxonomy FROM lined WHERE line IS NOT NULL AND unit = 'USD' AND taxonomy <> 'dei'),
    good AS (SELECT * FROM own WHERE taxonomy = first_taxonomy AND "end" <= listed AND {_SINCE} AND CASE WHEN line IN {_YEARS} THEN coalesce(date_diff('day', CAST("start" AS DATE), CAST("end" AS DATE)) BETWEEN 350 AND 380, false) ELSE "start" IS NULL END),
    best AS (SELECT id, line, "end", coalesce("start", '') AS "start", filed, accn, concept, val FROM good QUALIFY row_number() OVER (PARTITION BY id, line, "end" ORDER BY filed, accn, rank) = 1),
    closes AS (SELECT DISTINCT id, "end" FROM best WHERE line IN ('revenue', 'net_income')),
    total AS ({_balance("debt_m", "debt")}),
    covers AS (SELECT id, 'post_issue_shares_m' AS field, val / 1000000 AS v, "end", '' AS "start", filed, accn, concept FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY filed, "end", accn) AS nth FROM facts JOIN listed USING (id) WHERE taxonomy = 'dei' AND concept = 'EntityCommonStockSharesOutstanding' AND unit = 'shares' AND val IS NOT NULL AND {_SINCE}) WHERE nth = 1),
    shown AS ({_nth("revenue_m", "revenue", 1)} UNION ALL {_nth("revenue_prev_m", "revenue", 2)} UNION ALL {_nth("revenue_2y_ago_m", "revenue", 3)} UNION ALL {_nth("net_income_m", "net_income", 1)} UNION ALL {_nth("cfo_m", "cfo", 1)}
        UNION ALL {_sum("ebitda_m", "operating_income", "d_and_a", "")} UNION ALL {_balance("cash_m", "cash")} UNION ALL SELECT * FROM total
        UNION ALL SELECT * FROM ({_sum("debt_m", "debt_current", "debt_noncurrent", "c.id IS NULL,")}) WHERE id NOT IN (SELECT id FROM total) UNION ALL SELECT * FROM covers)
    SELECT id, field, floor(v * 100 + 0.5) / 100 AS "value", "end" AS period_end, "start" AS period_start, filed, filed AS available_at, accn, concept,
        CASE field WHEN 'post_issue_shares_m' THEN 'first_periodic_report' ELSE 'xbrl_post_ipo_comparative' END AS rule FROM shown"""


def facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as facts, and their companies' days of listing."""
    table(spark, d, "events").createOrReplaceTempView("_events")
    read = lambda sql: spark.sql(f"SELECT * FROM ({sql.partition(' AS (')[2][:-1]})".replace("FROM events", "FROM _events").replace("//", "DIV").replace('"', "`"))
    return read(FACTS_SQL), read(LISTED_SQL)


@query(STATEMENT_SQL)
def xbrl_statement(spark: SparkSession, d: str) -> DataFrame:
    rows, listed = facts(spark, d)
    s = filings.statement(rows, "id", listed, "listed")
    return s.select("id", "field", (F.floor(F.col("value") * 100 + 0.5) / 100).alias("value"), "period_end", "period_start", "filed", "available_at", "accn", "concept", "rule")


_TOLD = """o AS (SELECT l_partkey AS id, 'f' || CAST(l_linenumber % 3 AS VARCHAR(1)) AS field, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS period, CASE WHEN l_suppkey % 3 = 0 THEN 'prospectus' WHEN l_suppkey % 3 = 1 THEN 'xbrl' ELSE 'other' END AS source, CASE WHEN l_orderkey % 11 > 0 THEN floor(l_quantity / 10) END AS "value" FROM lineitem)"""


@query(f"""WITH {_TOLD}, per AS (SELECT id, field, period, max("value") FILTER (source = 'prospectus') AS a, max("value") FILTER (source = 'xbrl') AS b, bool_or(source = 'prospectus') AS has_a, bool_or(source = 'xbrl') AS has_b FROM o WHERE source <> 'other' GROUP BY 1, 2, 3),
    n AS (SELECT id, field, max(period) FILTER (has_a) AS x, max(period) FILTER (has_b) AS y, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS same, count(*) FILTER (abs(a - b) <= 0.01 * greatest(abs(a), abs(b), 1e-9)) AS agree FROM per GROUP BY 1, 2)
    SELECT field, count(*) AS "both", count(*) FILTER (x > y) AS a_leads, count(*) FILTER (y > x) AS b_leads, count(*) FILTER (x = y) AS same_newest, count(*) FILTER (abs(date_diff('day', CAST(x AS DATE), CAST(y AS DATE))) > 365) AS stale, CAST(sum(same) AS BIGINT) AS same_period, CAST(sum(agree) AS BIGINT) AS agree
    FROM n WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY field""")
def later_periods(spark: SparkSession, d: str) -> DataFrame:
    """Whether one source's newest period is later than the other's, over all line items as observations."""
    li = table(spark, d, "lineitem")
    source = F.element_at(F.array(F.lit("prospectus"), F.lit("xbrl"), F.lit("other")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = li.select(F.col("l_partkey").alias("id"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("field"), F.col("l_shipdate").cast("date").cast("string").alias("period"), source.alias("source"), F.when(F.col("l_orderkey") % 11 > 0, F.floor(F.col("l_quantity") / 10)).cast("double").alias("value"))
    return resolve.periods_between(rows, "id", "field", "period", "source", "value", "prospectus", "xbrl", stale=365)
