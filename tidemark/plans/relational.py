"""Queries over rows: search, facets, histograms, latest and earliest, de-duplication, resolution, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import basic, dates, rules, text
from tidemark.operators import ranked, resolve, summaries
from tidemark.plans.base import EVIDENCE_SQL, ISSUES_SQL, evidence, issues, query, r4, table

SEARCHED = ["company", "symbol", "sector"]


@query(f"""WITH {ISSUES_SQL} SELECT id, company, symbol, sector, country, status FROM issues
    WHERE country = 'India' AND status = 'Listed' AND (contains(lower(company), '00') OR contains(lower(symbol), '00') OR contains(lower(sector), '00'))""")
def scan_filter_search(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).filter("country = 'India' and status = 'Listed'")
    return text.search(i, "00", SEARCHED).select("id", "company", "symbol", "sector", "country", "status")


@query(f"WITH {ISSUES_SQL} SELECT id, company, status, age_days FROM issues WHERE status <> 'Not IPO' ORDER BY age_days, id LIMIT 500")
def default_exclusion_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked.top(issues(spark, d).filter("status <> 'Not IPO'").select("id", "company", "status", "age_days"), 500, F.asc("age_days"), F.asc("id"))


@query(f"WITH {ISSUES_SQL} SELECT symbol, count(*) AS n FROM issues GROUP BY symbol ORDER BY n DESC, symbol LIMIT 40")
def facet_counts_top40(spark: SparkSession, d: str) -> DataFrame:
    return summaries.facets(issues(spark, d), "symbol")


@query("""WITH w AS (SELECT unnest(['O', 'F', 'P', 'X', 'Y']) AS o_orderstatus, generate_subscripts(['O', 'F', 'P', 'X', 'Y'], 1) - 1 AS nth)
    SELECT o_orderstatus, CAST(nth AS INT) AS nth, count(o_orderkey) AS n FROM w LEFT JOIN orders USING (o_orderstatus) GROUP BY 1, 2""")
def status_histogram_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return summaries.zero_filled(table(spark, d, "orders"), "o_orderstatus", ["O", "F", "P", "X", "Y"])


@query(f"WITH {ISSUES_SQL} SELECT country, status, count(*) AS n, CAST(grouping_id(country, status) AS BIGINT) AS level FROM issues GROUP BY ROLLUP (country, status)")
def two_level_histogram_rollup(spark: SparkSession, d: str) -> DataFrame:
    return summaries.histogram(issues(spark, d), "country", "status")


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups_having(spark: SparkSession, d: str) -> DataFrame:
    return summaries.duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


_LATEST = "SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS n FROM orders) WHERE n = 1"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", F.col("o_orderdate").cast("date").alias("day"))


@query(_LATEST.format("DESC"), days=("day",))
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranked.latest(_orders(spark, d), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(_LATEST.format("ASC"), days=("day",))
def earliest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranked.earliest(_orders(spark, d), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def latest_values_aggregated(spark: SparkSession, d: str) -> DataFrame:
    return ranked.latest_values(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_totalprice", "o_orderstatus"])


_FULL = ["price_high", "revenue_m", "net_income_m", "cfo_m"]


@query(f"""WITH {ISSUES_SQL}, f AS (SELECT id, symbol, {" + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in _FULL)} AS full_ FROM issues WHERE symbol <> ''),
    r AS (SELECT id, symbol, row_number() OVER w AS n, first_value(id) OVER w AS kept_id FROM f WINDOW w AS (PARTITION BY symbol ORDER BY full_ DESC, id))
    SELECT id, symbol, kept_id, n = 1 AS kept, CASE WHEN n > 1 THEN 'duplicate of ' || kept_id END AS reason FROM r""")
def dedupe_keep_best_with_reason(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).filter("symbol <> ''")
    full = sum((F.col(c).isNotNull().cast("int") for c in _FULL[1:]), F.col(_FULL[0]).isNotNull().cast("int"))
    return ranked.keep_best(i.select("id", "symbol", *_FULL), ["symbol"], full, "id").drop(*_FULL)


@query("""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || p_partkey END AS slug FROM n""")
def slug_collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    return ranked.unique_slugs(table(spark, d, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug")), "slug", "p_partkey")


@query("""SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS r FROM lineitem""")
def average_rank_ties(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_quantity")
    return ranked.average_rank(li, "l_quantity", "r", ["l_suppkey"]).select("l_suppkey", "line", "r")


@query(f"""WITH {EVIDENCE_SQL}, s AS (SELECT entity, field, source, min("value") AS lo, max("value") AS hi FROM evidence GROUP BY ALL)
    SELECT a.entity, a.field, min(x.sources) AS sources, min(x.least) AS least, max(x.greatest) AS greatest, {r4("max(abs(a.lo - b.hi) / greatest(abs(a.lo), abs(b.hi), 1e-9))")} AS gap
    FROM s a JOIN s b ON a.entity = b.entity AND a.field = b.field AND a.source <> b.source JOIN (SELECT entity, field, count(*) AS sources, min(lo) AS least, max(hi) AS greatest FROM s GROUP BY ALL) x ON x.entity = a.entity AND x.field = a.field
    GROUP BY 1, 2 HAVING max(abs(a.lo - b.hi) / greatest(abs(a.lo), abs(b.hi), 1e-9)) > 0.04""")
def cross_source_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.conflicts(evidence(spark, d), ["entity", "field"], "source", "value").withColumn("gap", basic.steady(F.col("gap"), 4))


@query(f"""WITH {EVIDENCE_SQL} SELECT a."row" AS id_a, b."row" AS id_b, a.entity, a.field, {r4('abs(a."value" - b."value") / greatest(abs(a."value"), abs(b."value"), 1e-9)')} AS gap
    FROM evidence a JOIN evidence b ON a.entity = b.entity AND a.field = b.field AND a."row" < b."row" AND a.source <> b.source WHERE abs(a."value" - b."value") / greatest(abs(a."value"), abs(b."value"), 1e-9) > 0.04""")
def cross_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.conflicting_pairs(evidence(spark, d), ["entity", "field"], "row", "source", "value").select("id_a", "id_b", "entity", "field", basic.steady(F.col("gap"), 4).alias("gap"))


@query(f"""WITH {EVIDENCE_SQL}, w AS (SELECT entity, field, max(CASE WHEN source = 1 THEN "value" END) AS a, max(CASE WHEN source = 2 THEN "value" END) AS b FROM evidence GROUP BY ALL)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE abs(a - b) <= 0.01 * greatest(abs(a), abs(b))) AS agree FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def pairwise_agreement_1pct(spark: SparkSession, d: str) -> DataFrame:
    return resolve.agreement(evidence(spark, d), ["entity", "field"], "source", "value", 1, 2)


@query("""WITH master AS (SELECT c_custkey AS symbol, c_mktsegment AS name_key, DATE '1996-06-01' + CAST(c_custkey * 7 % 700 AS INT) AS listed_on FROM customer UNION ALL SELECT s_suppkey * 3, 'BUILDING', DATE '1996-07-01' FROM supplier),
    one AS (SELECT symbol, count(*) AS n, min(name_key) AS name_key, min(listed_on) AS listed_on FROM master GROUP BY 1)
    SELECT e.event_id, e.symbol, CASE WHEN n = 1 AND one.name_key = e.name_key AND listed_on - closed BETWEEN 0 AND 30 THEN listed_on END AS listed_on
    FROM (SELECT event_id, user_id AS symbol, CASE event_id % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS name_key, DATE '1996-06-01' + CAST(event_id % 700 AS INT) AS closed FROM events) e LEFT JOIN one USING (symbol)""", days=("listed_on",))
def interval_join_30d(spark: SparkSession, d: str) -> DataFrame:
    """Events as live issues; customers as the master, in which suppliers repeat some symbols."""
    day = lambda n: F.date_add(F.to_date(F.lit("1996-06-01")), n.cast("int"))
    live = table(spark, d, "events").select("event_id", F.col("user_id").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("name_key"), day(F.col("event_id") % 700).alias("closed"))
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("name_key"), day(F.col("c_custkey") * 7 % 700).alias("listed_on"))
    two = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("symbol"), F.lit("BUILDING").alias("name_key"), F.to_date(F.lit("1996-07-01")).alias("listed_on"))
    return resolve.listed_after(live, one.union(two)).select("event_id", "symbol", "listed_on")


@query(f"""WITH {ISSUES_SQL} SELECT id, symbol, country FROM issues a WHERE status IN ('Open', 'Closed', 'Upcoming') AND NOT EXISTS (SELECT 1 FROM issues b WHERE b.status = 'Listed' AND b.country = a.country AND b.symbol = a.symbol)""")
def supersede_anti_join(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id", "symbol", "country", "status")
    return resolve.superseded(i.filter(F.col("status").isin("Open", "Closed", "Upcoming")), i.filter("status = 'Listed'"), ["country", "symbol"]).select("id", "symbol", "country")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N')""")
def semi_anti_new_keys(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return resolve.new_rows(li.filter("l_returnflag = 'N'").select("l_orderkey", "l_linenumber"), li.select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH {ISSUES_SQL}, known AS (SELECT id, CAST(id % 300 AS VARCHAR) AS ek, CASE WHEN id % 2 = 0 THEN 'I' || (id % 400) ELSE '' END AS isin, 'n' || (id % 500) AS nk FROM issues WHERE id % 2 = 0 OR id % 3 = 0),
    items AS (SELECT id AS item, CAST(id % 900 AS VARCHAR) AS ek, 'I' || (id % 800) AS isin, 'n' || (id % 1000) AS nk FROM issues),
    a AS (SELECT ek, min(id) AS m FROM known GROUP BY 1), b AS (SELECT isin, min(id) AS m FROM known WHERE isin <> '' GROUP BY 1), c AS (SELECT nk, min(id) AS m FROM known GROUP BY 1)
    SELECT item, coalesce(a.m, b.m, c.m) AS match_id, CASE WHEN a.m IS NOT NULL THEN 'ek' WHEN b.m IS NOT NULL THEN 'isin' WHEN c.m IS NOT NULL THEN 'nk' END AS matched_by
    FROM items LEFT JOIN a USING (ek) LEFT JOIN b USING (isin) LEFT JOIN c USING (nk)""")
def multi_key_resolution_priority(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id")
    known = i.filter("id % 2 = 0 or id % 3 = 0").selectExpr("id", "cast(id % 300 as string) ek", "case when id % 2 = 0 then concat('I', id % 400) else '' end isin", "concat('n', id % 500) nk")
    items = i.selectExpr("id item", "cast(id % 900 as string) ek", "concat('I', id % 800) isin", "concat('n', id % 1000) nk")
    return resolve.by_priority(items, known, ["ek", "isin", "nk"], "id", []).select("item", "match_id", "matched_by")


@query(f"""WITH {ISSUES_SQL}, m AS (SELECT 'INE' || lpad(CAST(id % 200 AS VARCHAR), 4, '0') || '01' || (id % 3) AS isin, 'n' || (id % 350) AS name_key, 's' || (id % 350) AS symbol FROM issues WHERE id % 2 = 0),
    it AS (SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE 'INE' || lpad(CAST(id % 230 AS VARCHAR), 4, '0') || '01' || (id % 5) END AS isin, 'n' || (id % 420) AS name_key FROM issues),
    i AS (SELECT isin, count(DISTINCT symbol) AS n, min(symbol) AS s FROM m GROUP BY 1), k AS (SELECT name_key, count(DISTINCT symbol) AS n, min(symbol) AS s, arg_min(isin, (symbol, isin)) AS x FROM m GROUP BY 1)
    SELECT id, CASE WHEN i.n = 1 THEN 'RESOLVED_ISIN' WHEN i.n > 1 THEN 'AMBIGUOUS' WHEN k.n IS NULL THEN 'UNRESOLVED' WHEN k.n > 1 THEN 'AMBIGUOUS' WHEN it.isin = '' THEN 'UNRESOLVED' WHEN substr(x, 1, 7) = substr(it.isin, 1, 7) THEN 'NAME_ISIN_PREFIX' ELSE 'CONFLICTING' END AS outcome
    FROM it LEFT JOIN i ON i.isin = it.isin LEFT JOIN k ON k.name_key = it.name_key""")
def master_resolution_outcomes(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id")
    m = i.filter("id % 2 = 0").selectExpr("concat('INE', lpad(cast(id % 200 as string), 4, '0'), '01', id % 3) isin", "concat('n', id % 350) name_key", "concat('s', id % 350) symbol")
    it = i.selectExpr("id", "case when id % 4 = 0 then '' else concat('INE', lpad(cast(id % 230 as string), 4, '0'), '01', id % 5) end isin", "concat('n', id % 420) name_key")
    return resolve.against_master(it, m).select("id", "outcome")


@query(f"""WITH {ISSUES_SQL}, o AS (SELECT id, company, status, price_high FROM issues WHERE id % 3 > 0), n AS (SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE 'new ' || id END AS company, CASE WHEN id % 5 = 0 THEN 'Open' ELSE 'Listed' END AS status, CASE WHEN id % 4 = 0 THEN NULL ELSE price_high + 1 END AS price_high FROM issues WHERE id % 3 < 2),
    rk AS (SELECT unnest(['Filed', 'Upcoming', 'Open', 'Closed', 'Priced', 'Listed', 'Withdrawn', 'Not IPO']) AS s, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) AS r)
    SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.company, ''), o.company) AS company, CASE WHEN n.status IS NULL THEN o.status WHEN o.status IS NULL OR b.r >= a.r THEN n.status ELSE o.status END AS status, coalesce(n.price_high, o.price_high) AS price_high
    FROM o FULL JOIN n ON o.id = n.id LEFT JOIN rk a ON a.s = o.status LEFT JOIN rk b ON b.s = n.status""")
def upsert_merge_no_regression(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d)
    new = i.filter("id % 3 < 2").selectExpr("id", "case when id % 2 = 0 then '' else concat('new ', id) end company", "case when id % 5 = 0 then 'Open' else 'Listed' end status", "case when id % 4 = 0 then null else price_high + 1 end price_high")
    return resolve.merged(i.filter("id % 3 > 0").select("id", "company", "status", "price_high"), new, "id")


@query("""SELECT o_custkey, arg_max(o_orderstatus, (CASE o_orderstatus WHEN 'P' THEN 50 WHEN 'F' THEN 60 ELSE 30 END)) AS status FROM orders GROUP BY 1""")
def lifecycle_state_max(spark: SparkSession, d: str) -> DataFrame:
    name = F.create_map(*[F.lit(x) for x in ("P", "Priced", "F", "Listed", "O", "Open")])
    o = table(spark, d, "orders").withColumn("rank", rules.lifecycle_rank(name[F.col("o_orderstatus")]))
    return o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "rank").alias("status"))


@query(f"""WITH {ISSUES_SQL}, b AS (SELECT *, CASE WHEN country <> 'India' AND status = 'Filed' AND age_days > 365 THEN 'stale filing' WHEN country = 'India' AND status = 'Closed' AND age_days > 45 THEN 'closed without a listing' END AS reason FROM issues)
    SELECT CASE WHEN status = 'Withdrawn' THEN 'withdrawn' WHEN status = 'Not IPO' THEN 'excluded' WHEN status = 'Listed' THEN 'history' WHEN reason IS NOT NULL THEN reason ELSE 'upcoming' END AS bucket, count(*) AS n FROM b GROUP BY 1""")
def exclusion_reason_buckets(spark: SparkSession, d: str) -> DataFrame:
    why = rules.exclusion(F.col("country"), F.col("status"), F.col("data_flags"), F.col("age_days"), F.col("age_days"))
    bucket = basic.pick((F.col("status") == "Withdrawn", "withdrawn"), (F.col("status") == "Not IPO", "excluded"), (F.col("status") == "Listed", "history"), (why.isNotNull(), why), otherwise="upcoming")
    return summaries.partitioned(issues(spark, d), bucket)[1]


@query("""SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-08-01' AND DATE '2001-08-01' THEN true ELSE false END AS inside FROM orders""")
def rolling_5y_window(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_date(F.lit("2001-08-01"))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").between(dates.window_start(now), now).alias("inside"))


@query("""SELECT event_type, CASE WHEN h <= 4 THEN 'LIVE' WHEN h <= 48 THEN 'DELAYED' ELSE 'STALE' END AS freshness FROM (SELECT event_type, (epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 3600 AS h FROM events GROUP BY 1)""")
def source_freshness_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    hours = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.col("ts").cast("double")) / 3600
    return e.select("event_type", dates.freshness(hours).alias("freshness"))


@query(f"""WITH {ISSUES_SQL}, s AS (SELECT country, company, {", ".join(f"avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS has_{c}" for c in ("qib_sub", "cfo_m", "dual_class"))}, count(*) AS n FROM issues GROUP BY GROUPING SETS ((country, company)) HAVING false)
    SELECT country, count(*) AS n, {", ".join(r4(f"avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)") + f" AS has_{c}" for c in ("qib_sub", "cfo_m", "dual_class"))} FROM issues GROUP BY 1""")
def coverage_per_column(spark: SparkSession, d: str) -> DataFrame:
    cols = ["qib_sub", "cfo_m", "dual_class"]
    return summaries.coverage(issues(spark, d), cols, ["country"]).withColumns({f"has_{c}": basic.steady(F.col(f"has_{c}"), 4) for c in cols})


@query("""WITH s AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, n, min(o_totalprice) FILTER (WHERE i = least(n - 1, floor(n * 0.1))) AS p10, min(o_totalprice) FILTER (WHERE i = least(n - 1, floor(n * 0.5))) AS p50, min(o_totalprice) FILTER (WHERE i = least(n - 1, floor(n * 0.9))) AS p90 FROM s GROUP BY 1, 2""")
def quantile_index_p10_p50_p90(spark: SparkSession, d: str) -> DataFrame:
    return summaries.index_quantiles(table(spark, d, "orders"), "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["o_orderstatus"])


@query("""SELECT l_suppkey, arg_max(l_returnflag, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS worst FROM lineitem GROUP BY 1""")
def worst_status_per_source(spark: SparkSession, d: str) -> DataFrame:
    return summaries.worst(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", {"R": 3, "A": 2, "N": 1})


@query(f"""WITH {ISSUES_SQL} SELECT id, kind, days FROM (SELECT id, unnest(['age', 'lockup', 'flags']) AS kind, unnest([age_days, lockup_days, n_data_flags]) AS days FROM issues) WHERE days IS NOT NULL ORDER BY days DESC, id, kind LIMIT 160""")
def unpivot_dates_calendar(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id", F.col("age_days").alias("age"), F.col("lockup_days").alias("lockup"), F.col("n_data_flags").alias("flags"))
    return i.unpivot("id", ["age", "lockup", "flags"], "kind", "days").filter("days is not null").orderBy(F.desc("days"), "id", "kind").limit(160)


@query(f"""WITH {ISSUES_SQL}, obs AS (SELECT id, f AS field, id % 9 AS period_end, 1.0 * (id % 100) AS v FROM issues, (SELECT unnest(['cfo_m', 'qib_sub']) AS f) WHERE id % 2 = 0)
    SELECT id, coalesce(cfo_m, CASE WHEN id % 2 = 0 THEN CAST(id % 100 AS DOUBLE) END) AS cfo_m, coalesce(qib_sub, CASE WHEN id % 2 = 0 THEN CAST(id % 100 AS DOUBLE) END) AS qib_sub FROM issues""")
def fill_from_observations(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id", "cfo_m", "qib_sub")
    obs = i.filter("id % 2 = 0").select("id", F.explode(F.array(F.lit("cfo_m"), F.lit("qib_sub"))).alias("field"), (F.col("id") % 9).alias("period_end"), (F.col("id") % 100).cast("double").alias("value"))
    return resolve.filled(i, obs, "id", ["cfo_m", "qib_sub"])
