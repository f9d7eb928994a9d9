"""Queries over ledgers, names and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, rules, text
from tidemark.functions.basic import steady
from tidemark.operators import ledger, ranked
from tidemark.plans.base import EVIDENCE_SQL, ISSUES_SQL, PAIRS_SQL, evidence, issues, pairs, query, r4, table

_CATEGORY = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(rules.GRADES)) + " END"
_LEDGER = f"ledger AS (SELECT o_orderkey AS prediction, o_custkey AS entity, {_CATEGORY} AS category, o_orderpriority AS market, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS tried_on FROM orders)"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders as predictions, of which each has a category."""
    category = F.element_at(F.array(*map(F.lit, rules.GRADES)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("prediction"), F.col("o_custkey").alias("entity"), category.alias("category"), F.col("o_orderpriority").alias("market"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date")).alias("tried_on"))


@query(f"WITH {_LEDGER} SELECT market, count(DISTINCT entity) AS entities FROM ledger WHERE category = 'GRADED' GROUP BY 1")
def graded_entities(spark: SparkSession, d: str) -> DataFrame:
    return ledger.graded_entities(_ledger(spark, d), "market", "entity")


@query(f"WITH {_LEDGER} SELECT count(*) AS total, count(*) FILTER (WHERE category IN {rules.GRADABLE}) AS gradable, count(*) FILTER (WHERE category = 'GRADED') AS graded, count(*) FILTER (WHERE starts_with(category, 'BLOCKED')) AS blocked FROM ledger")
def grading_headline(spark: SparkSession, d: str) -> DataFrame:
    return ledger.headline(_ledger(spark, d))


@query(f"WITH {_LEDGER}, g AS (SELECT unnest({list(rules.GRADES)}) AS category, generate_subscripts({list(rules.GRADES)}, 1) - 1 AS place), n AS (SELECT market, category, count(*) AS n FROM ledger GROUP BY ALL) SELECT m.market, g.category, CAST(g.place AS INT) AS place, coalesce(n, 0) AS n FROM (SELECT DISTINCT market FROM ledger) m CROSS JOIN g LEFT JOIN n ON n.market = m.market AND n.category = g.category")
def ledger_report(spark: SparkSession, d: str) -> DataFrame:
    return ledger.report(_ledger(spark, d), "market")


@query(f"WITH {_LEDGER} SELECT prediction, category FROM ledger WHERE (starts_with(category, 'BLOCKED') OR category = 'PENDING') AND (tried_on IS NULL OR tried_on <= DATE '1997-01-15' - 14)")
def retry_due(spark: SparkSession, d: str) -> DataFrame:
    return ledger.due_again(_ledger(spark, d), F.to_date(F.lit("1997-01-15"))).select("prediction", "category")


@query("WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), l AS (SELECT CAST(l_shipdate AS DATE) AS day, CASE max(l_orderkey * 10 + l_linenumber) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'holiday' ELSE 'error' END AS outcome FROM lineitem WHERE l_shipdate < DATE '1998-01-01' GROUP BY 1), f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, true AS f FROM orders WHERE o_orderpriority = '1-URGENT'), w AS (SELECT o.day, CASE WHEN outcome IS NULL THEN 'new' WHEN outcome = 'error' THEN 'error' WHEN f AND outcome <> 'holiday' THEN 'forced' END AS why FROM o LEFT JOIN l USING (day) LEFT JOIN f USING (day)) SELECT day, why FROM w WHERE why IS NOT NULL", days=("day",))
def days_to_read(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders as a calendar; shipments as the ledger of what was read; urgent orders' days are forced."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    li = table(spark, d, "lineitem").filter("l_shipdate < date'1998-01-01'").select(F.col("l_shipdate").cast("date").alias("day"), F.element_at(F.array(*map(F.lit, ("ok", "holiday", "error"))), (n % 3 + 1).cast("int")).alias("outcome"), n.alias("tried_at"))
    return ledger.days_to_read(o, li, o.filter("o_orderpriority = '1-URGENT'"))


@query(f"WITH {ISSUES_SQL} SELECT status, count(*) AS n, max(id) AS latest FROM issues GROUP BY 1")
def status_latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest_by_status(issues(spark, d), "status", "id")


@query("SELECT min(CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END) AS first_day, max(o_orderkey) AS last_target FROM orders", days=("first_day",))
def backfill_edges(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise("soon")
    return ledger.edges(table(spark, d, "orders").select(day.alias("day"), "o_orderkey"), "day", "o_orderkey")


@query("SELECT c_custkey, is_member FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS is_member FROM customer) ORDER BY is_member, c_custkey LIMIT 300")
def snapped_last_order(spark: SparkSession, d: str) -> DataFrame:
    snapped = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ledger.members_last(table(spark, d, "customer").select("c_custkey"), snapped, "c_custkey", 300)


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 6")
def newest_since(spark: SparkSession, d: str) -> DataFrame:
    e = ledger.newest_since(table(spark, d, "events").select("event_id", "ts"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), "event_id")
    return e.select("event_id", F.unix_micros(dates.as_utc(F.col("ts"))).alias("us"))


@query("WITH a AS (SELECT c_custkey AS id, 0 AS list, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS nth FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_custkey, 1, row_number() OVER (ORDER BY c_custkey) FROM customer), f AS (SELECT id, min((list, nth)) AS m FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) SELECT id, CAST(m[1] AS INT) AS list, CAST(m[2] AS INT) AS nth FROM f ORDER BY 2, 3, 1 LIMIT 400")
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    first = c.filter("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_acctbal"), "id").limit(400).withColumn("nth", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "id")))
    second = c.orderBy("id").limit(400).withColumn("nth", F.row_number().over(Window.orderBy("id")))
    return ledger.in_turn([first, second], "id", 400)


@query(f"""WITH {ISSUES_SQL}, {EVIDENCE_SQL}, w AS (SELECT id AS entity, 'cross_field' AS kind, 'profit_vs_cash' AS code FROM issues WHERE net_income_m > 0 AND cfo_m < 0),
    x AS (SELECT DISTINCT a.entity, 'cross_source' AS kind, CAST(a.field AS VARCHAR) AS code FROM evidence a JOIN evidence b ON a.entity = b.entity AND a.field = b.field AND a.source <> b.source AND a.row < b.row WHERE abs(a."value" - b."value") / greatest(abs(a."value"), abs(b."value"), 1e-9) > 0.04)
    SELECT kind, count(*) AS n, count(DISTINCT entity) AS entities FROM (SELECT * FROM w UNION ALL SELECT * FROM x) GROUP BY 1""")
def findings_union(spark: SparkSession, d: str) -> DataFrame:
    own = issues(spark, d).select(F.col("id").alias("entity"), F.filter(rules.contradictions(), lambda c: c == "profit_vs_cash").alias("codes"))
    return ledger.all_findings(own, evidence(spark, d), "entity").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


@query(f"""WITH {PAIRS_SQL}, a AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM pairs a, pairs b WHERE a.y = 1 AND b.y = 0)
    SELECT count(*) AS n, 'evaluated' AS status, {r4("avg(power(p / 100 - y, 2))")} AS brier, {r4("first(a.auc)")} AS auc, {r4("avg(y) * 100")} AS positive_rate, {r4("avg(p)")} AS predicted_rate FROM pairs, a""")
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    m = ledger.model_block(pairs(spark, d))
    return m.select("n", "status", *[steady(F.col(c), 4).alias(c) for c in ("brier", "auc", "positive_rate", "predicted_rate")])


@query(f"WITH {PAIRS_SQL}, x AS (SELECT a.toxic, sum(CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM pairs a JOIN pairs b USING (toxic) WHERE a.y = 1 AND b.y = 0 GROUP BY 1), n AS (SELECT toxic, count(*) AS n FROM pairs GROUP BY 1) SELECT min(auc) > 0.5 AS stable FROM x JOIN n USING (toxic) WHERE n >= 20")
def segment_stability(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return spark.range(1).select(F.lit(ledger.segments_stable(p, "toxic")).cast("boolean").alias("stable"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'PROBABILITY' ELSE 'SCORE' END AS label, CASE WHEN o_orderkey % 30 = 0 THEN 'deployed model passed' WHEN o_orderkey % 2 = 0 THEN 'passed but not deployed' ELSE 'not passed' END AS reason FROM orders")
def score_semantics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = ledger.semantics(k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return table(spark, d, "orders").select("o_orderkey", s["label"].alias("label"), s["reason"].alias("reason"))


_RAW = "CASE c_custkey % 5 WHEN 0 THEN '4/A - ' || c_name || ' (0001804792) (Filer)' WHEN 1 THEN '  ' || c_name || '  Inc ' WHEN 2 THEN '10 - ' || c_name WHEN 3 THEN '5paisa ' || c_name END"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN '' WHEN c_custkey % 2 = 1 THEN trim(regexp_replace({_RAW}, '\\s+', ' ', 'g')) WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 5 = 1 THEN c_name || ' Inc' WHEN c_custkey % 5 = 2 THEN c_name ELSE '5paisa ' || c_name END AS name FROM customer")
def cleaned_company(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey")
    shapes = F.array(F.concat(F.lit("4/A - "), n, F.lit(" (0001804792) (Filer)")), F.concat(F.lit("  "), n, F.lit("  Inc ")), F.concat(F.lit("10 - "), n), F.concat(F.lit("5paisa "), n), F.lit(None).cast("string"))
    c = table(spark, d, "customer").select("c_custkey", F.element_at(shapes, (k % 5 + 1).cast("int")).alias("raw"), F.when(k % 2 == 1, "India").otherwise("US").alias("country"))
    return c.select("c_custkey", text.company_clean(F.col("raw"), F.col("country")).alias("name"))


@query("SELECT c_custkey, sha256(c_name) AS token, replace(replace(c_name, '#', '&lt;#&gt;'), 'C', '&amp;C') AS html, CASE WHEN c_custkey % 2 = 0 THEN 'IN:' ELSE 'US:' END || lower(c_name) AS natural_key, replace(lower(c_name), '#', '-') AS slug FROM customer")
def names_and_keys(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey")
    html = text.escaped(F.replace(F.replace(n, F.lit("C"), F.lit("&C")), F.lit("#"), F.lit("<#>")))
    none = F.lit(None).cast("string")
    return table(spark, d, "customer").select("c_custkey", text.token_hash(n).alias("token"), html.alias("html"), text.natural_key(F.when(k % 2 == 0, "India").otherwise("US"), none, none, n).alias("natural_key"), text.slug(n).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN [upper(c_name), upper(c_name) || '-UN'] WHEN c_custkey % 3 = 0 THEN [upper(c_name) || '-SM.NS', upper(c_name) || '.NS', upper(c_name) || '.BO'] ELSE [upper(c_name) || '.NS', upper(c_name) || '.BO'] END[1] AS best, c_custkey % 4 = 0 AS is_spac FROM customer")
def tickers(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey")
    t = text.ticker(n, F.when(k % 2 == 0, "India").otherwise("US"), F.when(k % 3 == 0, "SME").otherwise("Mainboard"))
    return table(spark, d, "customer").select("c_custkey", t[0].alias("best"), text.spac_name(F.when(k % 4 == 0, F.concat(n, F.lit(" Acquisition Corp"))).otherwise(n)).alias("is_spac"))


@query("SELECT o_orderkey, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS months, o_orderkey % 400 BETWEEN 350 AND 380 AS annual, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + 2 ELSE CAST(o_orderdate AS DATE) + 6 END AS available, CASE WHEN o_orderkey % 4 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 4000 <= 900 THEN 'LIVE' WHEN o_orderkey % 4000 <= 2700 THEN 'STALE' ELSE 'FAILED' END AS beat FROM orders", days=("available",))
def day_rules(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    some = F.when(k % 3 == 0, day)
    return table(spark, d, "orders").select(
        "o_orderkey", dates.months_apart(day, F.to_date(F.lit("1992-01-01"))).cast("long").alias("months"), dates.is_annual(day, F.date_add(day, (k % 400).cast("int"))).alias("annual"),
        dates.available_from(some, F.when(k % 3 == 1, F.date_add(day, 2)), F.date_add(day, 7)).alias("available"), dates.heartbeat(F.when(k % 4 > 0, k % 4000), 900).alias("beat"),
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice AS overall FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC")
def outcomes_of_issue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    out = ledger.outcomes_of(o.select(F.col("o_orderkey").alias("snapshot"), "o_custkey"), o.select(F.col("o_orderkey").alias("snapshot"), F.col("o_orderdate").alias("made_at"), F.col("o_totalprice").alias("overall")), "o_custkey", F.lit(7))
    return out.select(F.col("snapshot").alias("o_orderkey"), "o_custkey", "overall")


@query("SELECT max(epoch_us(ts)) AS newest, CASE WHEN max(ts) > TIMESTAMP '2024-01-10' THEN 'update' ELSE 'heartbeat' END AS event FROM events")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", dates.as_utc(F.col("ts")))
    seen = dates.as_utc(F.lit("2024-01-10 00:00:00"))
    return ledger.changed_since(e, "ts", seen).select(F.unix_micros("newest").alias("newest"), "event")


@query("WITH s AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot FROM orders GROUP BY 1), n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, to_json({'id': c_custkey, 'score': CASE WHEN snapshot IS NOT NULL THEN {'snapshot': snapshot} END, 'performance': CASE WHEN n IS NOT NULL THEN {'n': n} END})::VARCHAR AS document FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey")
def nested_projection(spark: SparkSession, d: str) -> DataFrame:
    """An entity with its latest score and its performance as one JSON document."""
    o = table(spark, d, "orders")
    score = ranked.latest_values(o, ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey"]).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("snapshot"))
    returns = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    whole = ledger.nested(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", score=score, performance=returns)
    return whole.select(F.col("id").alias("c_custkey"), ledger.frozen(whole, ["id", "score", "performance"]).alias("document"))


@query("SELECT o_orderstatus, count(*) AS rows, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM orders GROUP BY 1")
def tree_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.manifest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], "o_orderkey").withColumn("digest", F.col("digest").cast("long"))
