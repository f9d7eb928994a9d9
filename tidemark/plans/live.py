"""Queries that run streams over the events table until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base import query, table
from tidemark.sources.sinks import shared_folder
from tidemark.streaming import live, merge, outcomes, queue, stateful


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    kind = spark.read.parquet(path).schema
    s = spark.readStream.schema(kind)
    s = s.parquet(path) if spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1 else s.option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:8]}"


@query("SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    out = live.drained(live.tumbling(_stream(spark, d), "ts", ["event_type"]), _name("tumbling"), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "event_type", "n")


@query("""WITH w AS (SELECT user_id, epoch_us(ts) AS t, unnest(generate_series(0, 5)) AS i FROM events), b AS (SELECT user_id, (t // 600000000 - i) * 600 AS start, t FROM w) SELECT start, user_id, count(*) AS n FROM b WHERE t < (start + 3600) * 1000000 GROUP BY 1, 2 HAVING count(*) > 1""")
def stream_sliding_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    out = live.drained(live.over_limit(_stream(spark, d), "ts", "user_id", 1, "1 hour", "10 minutes"), _name("sliding"), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "user_id", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT epoch_us(min(ts)) // 1000000 AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = live.drained(live.sessions(_stream(spark, d), "ts", "user_id", "6 hours"), _name("sessions"), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_watermark(spark: SparkSession, d: str) -> DataFrame:
    return live.drained(live.deduplicated(_stream(spark, d), "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type"), _name("dedupe"), "append")


@query()
def stream_exact_limit(spark: SparkSession, d: str) -> DataFrame:
    """Which events a limit of two per hour and user would reject; held against brute force in the tests."""
    s = _stream(spark, d).select("user_id", "ts")
    return live.drained(live.limited(s, "ts", "user_id", 2, 3600.0), _name("limited"), "append").select(F.unix_micros("ts").alias("us"), "user_id", "rejected")


@query()
def stream_state_snapshotting(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).select("user_id", "ts", "value")
    return live.drained(live.snapshots(s, "user_id", "ts", "value", 50.0), _name("snapshots"), "append")


def _derived(spark: SparkSession, name: str, *batches: DataFrame) -> DataFrame:
    """A stream of batches that are first written to the shared folder, one after another."""
    folder = f"{shared_folder(spark)}/streams/{_name(name)}"
    for i, df in enumerate(batches):
        df.write.parquet(f"{folder}/batch={i}")
    return spark.readStream.schema(batches[0].schema).parquet(f"{folder}/batch=*")


_FIRST = """SELECT p.id, {n} AS attempt, min(v."at") AS "at", arg_min(v.price, struct_pack(a := v."at", b := v.price)) AS price FROM p LEFT JOIN v ON v.key = p.key AND v."at" BETWEEN p.due + {n} * INTERVAL 48 HOUR - INTERVAL 48 HOUR AND p.due + {n} * INTERVAL 48 HOUR - INTERVAL 42 HOUR GROUP BY p.id"""


@query(f"""WITH p AS (SELECT event_id AS id, user_id AS key, ts AS due FROM events WHERE event_id % 10 = 1), v AS (SELECT user_id AS key, ts AS "at", "value" AS price FROM events WHERE event_id % 3 = 0),
    t AS ({_FIRST.format(n=1)} UNION ALL {_FIRST.format(n=2)}),
    best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" IS NULL, CASE WHEN "at" IS NULL THEN -attempt ELSE attempt END) = 1)
    SELECT id, attempt, coalesce(epoch_us("at"), -1) AS at_us, price, CASE WHEN "at" IS NULL THEN 'BLOCKED_MARKET_DATA' ELSE 'GRADED' END AS category FROM best""")
def late_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event waits six hours for a price of its user, and again after two days; a row far ahead in either stream
    lets all of them be settled."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("key"), F.to_timestamp(F.lit("2200-01-01")).alias("at"), F.lit(0.0).alias("price"))
    asked = e.filter("event_id % 10 = 1").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("due")).unionByName(end.select("id", "key", F.col("at").alias("due")))
    prices = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("value").alias("price")).unionByName(end.drop("id"))
    out = outcomes.settled(_derived(spark, "asked", asked), _derived(spark, "prices", prices), "6 HOURS", 2, "48 HOURS")
    return out.filter("id >= 0").select("id", "attempt", F.coalesce(F.unix_micros("at"), F.lit(-1)).alias("at_us"), "price", "category")


_STATUS = "CASE WHEN event_id % 4 = 0 THEN [{}][CAST((user_id + event_id) % 8 AS INT) + 1] END"
_STATES = ", ".join(f"'{s}'" for s in (*stateful.STATES, "odd"))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, list_position([{", ".join(f"'{s}'" for s in stateful.STATES)}], {_STATUS.format(_STATES)}) AS rank, CASE WHEN event_id % 5 = 0 THEN event_type END AS flag FROM events),
    r AS (SELECT *, max(rank) OVER (PARTITION BY user_id ORDER BY us, rank ROWS UNBOUNDED PRECEDING) AS top, max(rank) OVER (PARTITION BY user_id ORDER BY us, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    moved AS (SELECT user_id, us, rank FROM r WHERE rank IS NOT NULL AND (before IS NULL OR (rank > before AND before < 5)))
    SELECT CAST(user_id AS VARCHAR) AS key, min(us) AS us, 'discovered' AS event, CAST(NULL AS VARCHAR) AS detail FROM e GROUP BY user_id
    UNION ALL SELECT CAST(user_id AS VARCHAR), us, 'status_changed', [{_STATES}][rank] FROM moved
    UNION ALL SELECT CAST(user_id AS VARCHAR), min(us), 'flag_raised', flag FROM e WHERE flag IS NOT NULL GROUP BY user_id, flag""")
def stream_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    """States and flags of users; scores, which depend on what was told last, are held against brute force in the tests."""
    s = _stream(spark, d)
    status = F.when(F.col("event_id") % 4 == 0, F.array(*map(F.lit, (*stateful.STATES, "odd")))[((F.col("user_id") + F.col("event_id")) % 8).cast("int")])
    rows = s.select(F.col("user_id").cast("string").alias("key"), F.unix_micros("ts").alias("us"), status.alias("status"), F.lit(None).cast("double").alias("score"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("flag"))
    return stateful.drained(stateful.lifecycles(rows), _name("lifecycles"))


@query("SELECT event_type AS key, 'data' AS event, epoch_us(max(ts)) AS us FROM events GROUP BY event_type")
def stream_change_feed(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drained(stateful.change_feed(_stream(spark, d), "event_type", "ts", 3600.0), _name("feed"), clocked=True)


_OBSERVED = """o AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS field, CAST(2020 + event_id % 3 AS VARCHAR) AS period_end, 's' || CAST(event_id % 4 AS VARCHAR) AS source, CAST(1 + event_id % 4 // 2 AS INT) AS tier, CASE WHEN event_id % 7 > 0 THEN 100 + floor("value") % 12 END AS "value", event_id AS seq FROM events)"""


@query(f"""WITH {_OBSERVED}, last AS (SELECT * FROM o WHERE "value" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, field, period_end, source ORDER BY seq DESC) = 1),
    said AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY id, field, source ORDER BY period_end DESC, seq DESC) = 1)
    SELECT id, field, source, tier, "value", EXISTS (SELECT 1 FROM said AS b WHERE b.id = a.id AND b.field = a.field AND b.source <> a.source AND abs(b."value" - a."value") / greatest(b."value", a."value") > 0.04) AS conflict FROM said AS a""")
def observation_merge(spark: SparkSession, d: str) -> DataFrame:
    """Provenance and conflicts after three batches of observations, the first of which comes twice."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("field"), (2020 + F.col("event_id") % 3).cast("string").alias("period_end"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"), (1 + F.floor(F.col("event_id") % 4 / 2)).cast("int").alias("tier"), F.when(F.col("event_id") % 7 > 0, 100 + F.floor("value") % 12).cast("double").alias("value"), F.col("event_id").alias("seq"))
    part = lambda i: rows.filter(F.pmod(F.hash("seq"), F.lit(3)) == i)
    kept = merge.MergedTable(spark, f"{shared_folder(spark)}/{_name('observations')}", 16)
    merge.merge_stream(_derived(spark, "observed", part(0), part(1), part(2), part(0)), kept, f"{shared_folder(spark)}/streams/{_name('merge')}")
    return kept.provenance()


_MESSAGES = """m AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS recipient, CASE WHEN o_orderkey % 3 = 0 THEN 'welcome' ELSE 'news' END AS template, CAST(1 + o_orderkey % 40 // 30 * (1 + o_orderkey % 3) AS INT) AS priority, CAST(epoch(o_orderdate) AS BIGINT) AS queued_at FROM orders)"""


@query(f"""WITH {_MESSAGES}, p AS (SELECT CAST(c_custkey AS VARCHAR) AS recipient, c_custkey % 10 = 0 AS suppressed, c_custkey % 4 > 0 AS consent FROM customer),
    j AS (SELECT m.*, CASE WHEN coalesce(suppressed, true) THEN 'SUPPRESSED' WHEN template <> 'welcome' AND NOT coalesce(consent, false) THEN 'UNSUBSCRIBED' END AS ended FROM m LEFT JOIN p USING (recipient)),
    n AS (SELECT *, row_number() OVER (PARTITION BY ended IS NULL, priority <= 1 ORDER BY priority, queued_at, id) AS nth FROM j),
    t AS (SELECT id FROM n WHERE ended IS NULL AND nth <= CASE WHEN priority <= 1 THEN 2000 ELSE 300 END ORDER BY priority, queued_at, id LIMIT 2000)
    SELECT id, CASE WHEN ended IS NOT NULL THEN ended WHEN t.id IS NULL THEN 'QUEUED' WHEN id * 7 % 5 > 1 THEN 'SENT' WHEN id % 3 = 1 THEN 'FAILED' ELSE 'QUEUED' END AS status, CAST(CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS INT) AS attempts FROM n LEFT JOIN t USING (id)""")
def queue_cycle(spark: SparkSession, d: str) -> DataFrame:
    """One cycle over all orders as messages: 2,000 are tried at most, of which 300 under the quota; cycles after each other, which
    depend on what failed before, are held against a simulation in the tests."""
    o = table(spark, d, "orders")
    bulk = F.floor(F.col("o_orderkey") % 40 / 30) * (1 + F.col("o_orderkey") % 3)
    messages = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("recipient"), F.when(F.col("o_orderkey") % 3 == 0, "welcome").otherwise("news").alias("template"), (1 + bulk).cast("int").alias("priority"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("queued_at"))
    people = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("recipient"), (F.col("c_custkey") % 10 == 0).alias("suppressed"), (F.col("c_custkey") % 4 > 0).alias("consent"))
    send = lambda tried: tried.select("id", (F.col("id") * 7 % 5 > 1).alias("ok"), (F.col("id") % 3 != 1).alias("retryable"))
    q = queue.Queue(spark, f"{shared_folder(spark)}/{_name('queue')}", send, 2000, 300)
    q.run(1, 2_000_000_000, messages, people, 0, 0)
    return q.messages().select("id", "status", "attempts")
