"""Queries over time series: as-of joins, return windows, trailing statistics, market regime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.basic import steady
from tidemark.operators import asof
from tidemark.plans.base import BARS_SQL, LISTINGS_SQL, bars, listings, query, r4, table

_EVENTS = "ev AS (SELECT o_orderkey, o_orderkey % 40 AS key, CAST(o_orderdate AS DATE) AS at_ FROM orders)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("key"), F.col("o_orderdate").cast("date").alias("at"))


@query(f"WITH {BARS_SQL}, {_EVENTS} SELECT o_orderkey, day AS ts, close FROM ev ASOF LEFT JOIN bars ON ev.key = bars.key AND ev.at_ >= bars.day", days=("ts",))
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof(_events(spark, d), bars(spark, d), ["key"], "at", "day", ["close"]).select("o_orderkey", "ts", "close")


@query(f"WITH {BARS_SQL}, {_EVENTS} SELECT o_orderkey, day AS ts, close FROM ev ASOF LEFT JOIN bars ON ev.key = bars.key AND ev.at_ <= bars.day", days=("ts",))
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof(_events(spark, d), bars(spark, d), ["key"], "at", "day", ["close"], forward=True).select("o_orderkey", "ts", "close")


@query(f"""WITH {BARS_SQL}, {_EVENTS}, few AS (SELECT key, date_diff('day', DATE '1970-01-01', day) AS n, close FROM bars), e AS (SELECT o_orderkey, key, date_diff('day', DATE '1970-01-01', at_) AS n FROM ev)
    SELECT o_orderkey, CASE WHEN e.n - few.n <= 1 THEN close END AS close FROM e ASOF LEFT JOIN few ON e.key = few.key AND e.n > few.n""")
def asof_staleness_bounded(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("n", F.unix_date("at"))
    b = bars(spark, d).withColumn("n", F.unix_date("day"))
    return asof.asof(e, b, ["key"], "n", "n", ["close"], strict=True, most=F.lit(1), prefix="bar_", span=365).select("o_orderkey", F.col("bar_close").alias("close"))


_OBS = """obs AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS period_end, CAST(l_shipdate AS DATE) + 30 AS available_at, CASE l_linenumber % 3 WHEN 0 THEN 'prospectus_filing' WHEN 1 THEN 'xbrl_post_ipo_comparative' ELSE 'hearsay' END AS rule, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_OBS}, e AS (SELECT o_orderkey, o_orderkey % 100 + 1 AS key, CAST(o_orderdate AS DATE) AS at_ FROM orders),
    j AS (SELECT o_orderkey, v, period_end, row_number() OVER (PARTITION BY o_orderkey ORDER BY period_end DESC, available_at DESC) AS n FROM e JOIN obs ON obs.key = e.key AND available_at <= at_ AND rule = 'prospectus_filing')
    SELECT e.o_orderkey, v AS val, period_end FROM e LEFT JOIN j ON j.o_orderkey = e.o_orderkey AND n = 1""", days=("period_end",))
def point_in_time_latest_available(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    day = F.col("l_shipdate").cast("date")
    rule = F.element_at(F.array(F.lit("prospectus_filing"), F.lit("xbrl_post_ipo_comparative"), F.lit("hearsay")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    obs = li.groupBy(F.col("l_suppkey").alias("key"), day.alias("period_end"), F.date_add(day, 30).alias("available_at"), rule.alias("rule")).agg(F.max("l_quantity").alias("value"))
    e = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 + 1).alias("key"), F.col("o_orderdate").cast("date").alias("at"))
    return asof.known_at(e, obs, ["key"], "at").select("o_orderkey", F.col("value").alias("val"), "period_end")


_RETURNS = f"""{BARS_SQL}, {LISTINGS_SQL}, edge AS (SELECT key, min(day) AS f, max(day) AS l FROM bars GROUP BY 1),
    sess AS (SELECT i.*, f, l, CASE WHEN f BETWEEN listed - 4 AND listed + 14 THEN f ELSE (SELECT min(day) FROM bars b WHERE b.key = i.key AND day >= listed AND day <= listed + 14) END AS s FROM listings i JOIN edge USING (key)),
    a AS (SELECT sess.*, b.open, b.close, (b.close / price - 1) * 100 AS lr FROM sess JOIN bars b ON b.key = sess.key AND b.day = s),
    c AS (SELECT *, price IS NOT NULL AND coalesce(abs(lr) <= 2000, true) AS ok FROM a),
    e AS (SELECT *, CASE WHEN ok THEN price ELSE close END AS base FROM c)"""
_WIN = {"return_7d": 7, "return_30d": 30, "return_90d": 90, "return_6m": 182, "return_12m": 365, "return_24m": 730}


@query(f"""WITH {_RETURNS} SELECT issue, s AS session_day, ok AS from_offer, {r4("CASE WHEN ok THEN lr END")} AS listing_return, {r4("CASE WHEN ok THEN (open / price - 1) * 100 END")} AS open_return, {r4("(close / open - 1) * 100")} AS day_return,
    {", ".join(f"CASE WHEN s + {n} <= l THEN {r4(f'((SELECT max_by(b.close, b.day) FROM bars b WHERE b.key = e.key AND b.day <= s + {n} AND b.day > s) / base - 1) * 100')} END AS {w}" for w, n in _WIN.items())},
    {r4("((SELECT b.close FROM bars b WHERE b.key = e.key AND b.day = l) / base - 1) * 100")} AS since_listing FROM e""", days=("session_day",))
def forward_return_windows(spark: SparkSession, d: str) -> DataFrame:
    r = asof.forward_returns(listings(spark, d), bars(spark, d), "key")
    cols = ["listing_return", "open_return", "day_return", *asof.WINDOWS, "since_listing"]
    return r.select("issue", "session_day", "from_offer", *[steady(F.col(c), 4).alias(c) for c in cols])


@query(f"""WITH {_RETURNS}, m AS (SELECT day, max(close) AS close FROM bars GROUP BY 1),
    x AS (SELECT issue, CASE WHEN s + 365 <= l THEN ((SELECT max_by(b.close, b.day) FROM bars b WHERE b.key = e.key AND b.day <= s + 365 AND b.day > s) / base - 1) * 100 END AS own,
      ((SELECT max_by(close, day) FROM m WHERE day <= s + 365) / (SELECT min_by(close, day) FROM m WHERE day >= s) - 1) * 100 AS bench FROM e)
    SELECT issue, {r4("own - bench")} AS relative FROM x""")
def benchmark_relative_12m(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    r = asof.forward_returns(listings(spark, d), b, "key").select("issue", "session_day", "return_12m").withColumn("end", F.date_add("session_day", 365))
    market = b.groupBy("day").agg(F.max("close").alias("close"))
    both = asof.on_calendar(asof.on_calendar(r, market, "session_day", "day", "close", "a_close", forward=True), market, "end", "day", "close", "b_close")
    return both.select("issue", steady(F.col("return_12m") - (F.col("b_close") / F.col("a_close") - 1) * 100, 4).alias("relative"))


@query(f"""WITH {LISTINGS_SQL} SELECT issue, {r4("price * CASE WHEN listed < DATE '1997-01-01' THEN 0.5e0 ELSE 1 END * CASE WHEN listed < DATE '1998-06-01' THEN 30.0e0 ELSE 1 END")} AS adjusted FROM listings""")
def split_adjusted_base(spark: SparkSession, d: str) -> DataFrame:
    splits = F.from_json(F.lit('[{"day":"1997-01-01","factor":0.5},{"day":"1998-06-01","factor":30.0}]'), "array<struct<day:date,factor:double>>")
    return listings(spark, d).select("issue", steady(F.col("price") * asof.split_factor(splits, F.col("listed")), 4).alias("adjusted"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders), d AS (SELECT o_orderstatus, day, count(*) AS n FROM o GROUP BY 1, 2),
    t AS (SELECT a.o_orderstatus, a.day, coalesce(sum(b.n), 0) AS n FROM d a LEFT JOIN d b ON a.o_orderstatus = b.o_orderstatus AND b.day >= a.day - 90 AND b.day < a.day GROUP BY 1, 2)
    SELECT o_orderkey, CAST(n AS BIGINT) AS n FROM o JOIN t USING (o_orderstatus, day)""")
def trailing_count_90d(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    return asof.trailing_count(o, "o_orderstatus", "day", 90).select("o_orderkey", "n")


@query(f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY key ORDER BY day)) AS x FROM bars), w AS (SELECT *, count(x) OVER q AS n, stddev_samp(x) OVER q AS s FROM r WINDOW q AS (PARTITION BY key ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT key, day, {r4("CASE WHEN n = 20 THEN s * sqrt(252.0e0) * 100 END")} AS vol FROM w""", days=("day",))
def trailing_vol_20(spark: SparkSession, d: str) -> DataFrame:
    return asof.volatility(bars(spark, d), "key").select("key", "day", steady(F.col("vol"), 4).alias("vol"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY key ORDER BY day)) AS x FROM bars), w AS (SELECT *, count(x) OVER q AS n, stddev_samp(x) OVER q AS s FROM r WINDOW q AS (PARTITION BY key ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    {LISTINGS_SQL}, a AS (SELECT i.issue, i.key, w.day AS ld, w.close AS lc, CASE WHEN n = 20 THEN s * sqrt(252.0e0) * 100 END AS vol FROM listings i ASOF LEFT JOIN w ON i.key = w.key AND i.listed > w.day AND true),
    b AS (SELECT a.*, i.listed, CASE WHEN i.listed - ld <= 7 THEN ld END AS d1 FROM a JOIN listings i USING (issue)), q AS (SELECT b.*, d1 - 60 AS fd FROM b),
    z AS (SELECT q.*, w.day AS bd, w.close AS bc FROM q ASOF LEFT JOIN w ON q.key = w.key AND q.fd <= w.day)
    SELECT issue, {r4("CASE WHEN vol IS NOT NULL AND bd - fd <= 7 AND bd < d1 THEN (lc / bc - 1) * 100 END")} AS market_return_60d, {r4("CASE WHEN vol IS NOT NULL AND bd - fd <= 7 AND bd < d1 THEN vol END")} AS market_vol_20d FROM z""")
def trailing_return_60d(spark: SparkSession, d: str) -> DataFrame:
    r = asof.regime(listings(spark, d), bars(spark, d), "key", "listed")
    return r.select("issue", *[steady(F.col(c), 4).alias(c) for c in ("market_return_60d", "market_vol_20d")])


@query(f"""WITH {BARS_SQL}, {LISTINGS_SQL}, i AS (SELECT key, min(listed) AS listed FROM listings GROUP BY 1)
    SELECT b.key, count(*) AS bars, count(*) FILTER (WHERE day >= DATE '2001-12-01' - 20 OR day BETWEEN listed AND listed + 21 OR day BETWEEN listed + 18 AND listed + 30 OR day BETWEEN listed + 78 AND listed + 90 OR day BETWEEN listed + 170 AND listed + 182 OR day BETWEEN listed + 353 AND listed + 365 OR day BETWEEN listed + 718 AND listed + 730) AS kept FROM bars b LEFT JOIN i ON i.key = b.key GROUP BY 1""")
def bar_retention(spark: SparkSession, d: str) -> DataFrame:
    i = listings(spark, d).groupBy("key").agg(F.min("listed").alias("listed"))
    j = bars(spark, d).join(i, "key", "left").withColumn("keep", asof.readable(F.col("day"), F.col("listed"), F.to_date(F.lit("2001-12-01"))))
    return j.groupBy("key").agg(F.count("*").alias("bars"), F.count_if("keep").alias("kept"))
