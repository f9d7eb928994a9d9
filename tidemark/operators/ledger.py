"""Ledgers: what was graded, what is due again, what was observed on a day, and the reports that are made of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.basic import pick
from tidemark.functions.rules import GRADABLE, GRADES
from tidemark.operators import metrics, resolve

#: Fixed: days after which a blocked outcome, or a failed price series, is tried again.
RETRY_BLOCKED_DAYS, RETRY_PRICES_DAYS = 14, 30
#: Fixed: predictions that a block of model metrics needs.
LEAST_SAMPLE = 20


def graded_entities(ledger: DataFrame, by: str, entity: str, category: str = "category") -> DataFrame:
    """(by, entities): distinct entities with a graded prediction."""
    return ledger.filter(F.col(category) == "GRADED").groupBy(by).agg(F.count_distinct(entity).alias("entities"))


def headline(ledger: DataFrame, category: str = "category") -> DataFrame:
    """One row: all predictions, those that could be graded, those that are, and how many are blocked."""
    c = F.col(category)
    return ledger.agg(F.count("*").alias("total"), F.count_if(c.isin(*GRADABLE)).alias("gradable"), F.count_if(c == "GRADED").alias("graded"), F.count_if(c.startswith("BLOCKED")).alias("blocked"))


def latest_by_status(df: DataFrame, status: str, ts: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))


def edges(df: DataFrame, text_day: str, target: str) -> DataFrame:
    """The first day that can be read from texts, and the greatest target: where a back-fill starts and stops."""
    from tidemark.functions.dates import parsed

    return df.agg(F.min(parsed(F.col(text_day))).alias("first_day"), F.max(target).alias("last_target"))


def nested(rows: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """rows with a struct (null where there is none) of each part's row of the same key: what is shown of an entity as one
    document. Parts have one row per key."""
    out = rows
    for name, part in parts.items():
        side = part.select(F.col(key).alias("_k"), F.struct(*[c for c in part.columns if c != key]).alias(name))
        out = out.join(side, F.col(key) == F.col("_k"), "left").drop("_k")
    return out


def manifest(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """What a tree of files holds: rows, least and greatest id of each folder, and a digest that changes with any row: the sum of
    the first 32 bits of each row's MD5, its values as texts joined by bars, nulls as nothing."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    digest = F.sum(F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), digest.alias("digest"))


def members_last(df: DataFrame, members: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows, those that members lacks first, then by id."""
    m = members.select(F.col(id_col).alias("_m")).distinct()
    j = df.join(m, F.col(id_col) == F.col("_m"), "left").withColumn("is_member", F.col("_m").isNotNull()).drop("_m")
    return j.orderBy("is_member", id_col).limit(n)


def newest_since(df: DataFrame, ts: str, cutoff: Column, id_col: str, n: int = 6) -> DataFrame:
    return df.filter(F.col(ts) >= cutoff).orderBy(F.desc(ts), id_col).limit(n)


def in_turn(lists: list[DataFrame], id_col: str, n: int) -> DataFrame:
    """(id, list, nth): lists (id, nth) one after another, an id where it comes first, cut to n."""
    every = None
    for i, x in enumerate(lists):
        one = x.select(id_col, F.lit(i).alias("list"), F.col("nth").cast("int").alias("nth"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy(id_col).agg(F.min(F.struct("list", "nth")).alias("_f")).select(id_col, "_f.list", "_f.nth")
    return first.orderBy("list", "nth", id_col).limit(n)


def all_findings(records: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, code): contradictions within a record and conflicts between sources, in one table. records have a column
    codes; evidence has id, field, source, value."""
    within = records.select(id_col, F.lit("cross_field").alias("kind"), F.explode("codes").alias("code"))
    apart = resolve.conflicts(evidence, [id_col, "field"], "source", "value")
    between = apart.select(id_col, F.lit("cross_source").alias("kind"), F.col("field").cast("string").alias("code"))
    return within.unionByName(between)


def outcomes_of(outcomes: DataFrame, snapshots: DataFrame, entity: str, wanted: Column) -> DataFrame:
    """Outcomes of one entity with their snapshots, the newest snapshot first."""
    return outcomes.filter(F.col(entity) == wanted).join(snapshots.select("snapshot", "made_at", "overall"), "snapshot").orderBy(F.desc("made_at"), F.desc("snapshot"))


def retry_horizon(today: Column) -> Column:
    """The day on or before which a blocked attempt is stale."""
    return F.date_sub(today, RETRY_BLOCKED_DAYS)


def due_again(ledger: DataFrame, today: Column) -> DataFrame:
    """Predictions to look at again: never tried, or blocked since the horizon. Graded ones never come back, holidays
    (category NOT_YET_ELIGIBLE) neither. ledger: category, tried_on."""
    blocked = F.col("category").startswith("BLOCKED") | (F.col("category") == "PENDING")
    return ledger.filter(blocked & (F.col("tried_on").isNull() | (F.col("tried_on") <= retry_horizon(today))))


def days_to_read(calendar: DataFrame, ledger: DataFrame, force: DataFrame | None = None) -> DataFrame:
    """(day, why): days of a calendar that have no outcome or ended in an error, never holidays; and days of force, which
    are read again whatever the ledger says, since keys were learnt late. ledger: day, outcome (ok, holiday, error)."""
    j = calendar.select("day").distinct().join(ledger.groupBy("day").agg(F.max_by("outcome", "tried_at").alias("outcome")), "day", "left")
    why = F.when(F.col("outcome").isNull(), "new").when(F.col("outcome") == "error", "error")
    if force is not None:
        j = j.join(force.select("day").distinct().withColumn("_f", F.lit(True)), "day", "left")
        why = F.when(F.col("_f") & (F.coalesce("outcome", F.lit("new")) != "holiday"), F.coalesce(why, F.lit("forced"))).otherwise(why)
    return j.withColumn("why", why).filter("why is not null").select("day", "why")


def observed_on(live: DataFrame, stored: DataFrame, fields: list[str], today: Column, stage: Column) -> DataFrame:
    """stored observations (id, field, day, value, stage) with those of today's live rows: one per id, field and day; a
    value that is seen again the same day replaces the one before, blanks write nothing."""
    new = live.select("id", stage.alias("stage"), *fields).unpivot(["id", "stage"], fields, "field", "value").filter("value is not null")
    new = new.groupBy("id", "field").agg(F.max(F.struct("value", "stage")).alias("v")).select("id", "field", today.alias("day"), F.col("v.value").alias("_value"), F.col("v.stage").alias("_stage"))
    j = stored.join(new, ["id", "field", "day"], "full_outer")
    return j.select("id", "field", "day", F.coalesce("_value", "value").alias("value"), F.coalesce("_stage", "stage").alias("stage"))


def beat(previous: DataFrame, name: str, now: Column, touched: tuple[str, ...], kinds: tuple[str, ...] = ("cycle", "performance", "history")) -> DataFrame:
    """The one row of a worker's heartbeat: now for what was touched, the former times for the rest."""
    old = {r["name"]: r for r in previous.filter(F.col("name") == name).limit(1).collect()}.get(name)
    times = [(now if k in touched else F.lit(old[f"{k}_at"] if old else None)).cast("timestamp").alias(f"{k}_at") for k in kinds]
    return previous.sparkSession.range(1).select(F.lit(name).alias("name"), now.cast("timestamp").alias("beat_at"), *times)


def model_block(df: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """One row of metrics of (p in percent, y); all but the count are null below least predictions."""
    b = metrics.brier(df).crossJoin(F.broadcast(metrics.log_loss(df))).crossJoin(F.broadcast(metrics.auc(df))).crossJoin(F.broadcast(metrics.ece(df)))
    rates = df.agg((F.avg("y") * 100).alias("positive_rate"), F.avg("p").alias("predicted_rate"))
    all_ = b.crossJoin(F.broadcast(rates))  # each side is one row
    told = ["brier", "log_loss", "auc", "ece", "positive_rate", "predicted_rate"]
    enough = F.col("n") >= least
    return all_.select("n", F.when(enough, "evaluated").otherwise("insufficient sample").alias("status"), *[F.when(enough, F.col(c)).alias(c) for c in told])


def segments_stable(df: DataFrame, segment: str, least: int = LEAST_SAMPLE, floor: float = 0.5) -> bool | None:
    """Whether AUC is above floor in every segment that has enough predictions; None if none has."""
    sizes = df.groupBy(segment).agg(F.count("*").alias("n"))
    found = metrics.auc(df, segment).join(sizes, segment).filter((F.col("n") >= least) & F.col("auc").isNotNull())
    low, n = found.agg(F.min("auc"), F.count("*")).first()
    return None if not n else bool(low > floor)


def semantics(gate_passed: Column, probability_allowed: Column, deployed: Column) -> Column:
    """struct(label, reason): numbers are scores until the model that passed is the one that makes them."""
    passed = F.coalesce(gate_passed, F.lit(False))
    calibrated = passed & F.coalesce(probability_allowed, passed) & F.coalesce(deployed, F.lit(False))
    reason = pick((calibrated, "deployed model passed"), (passed, "passed but not deployed"), otherwise="not passed")
    return F.struct(F.when(calibrated, "PROBABILITY").otherwise("SCORE").alias("label"), reason.alias("reason"))


def frozen(df: DataFrame, fields: list[str]) -> Column:
    """What a score was made from, as JSON in the order of fields, nulls included."""
    return F.to_json(F.struct(*[F.col(f) for f in fields if f in df.columns]), {"ignoreNullFields": "false"})


def changed_since(log: DataFrame, ts: str, seen: Column) -> DataFrame:
    """One row: whether anything is newer than what was seen, and the newest time."""
    return log.agg(F.max(ts).alias("newest")).select("newest", F.when(F.col("newest") > seen, "update").otherwise("heartbeat").alias("event"))


def reconciled(items: DataFrame, master: DataFrame) -> DataFrame:
    """items (id, isin, name_key, symbol) held against a master (isin, name_key, symbol): the outcome, the symbol to take
    and what to do: adopt it, keep it, or ask."""
    out = resolve.against_master(items, master)
    agrees = F.upper("symbol") == F.upper("master_symbol")
    action = pick((F.col("master_symbol").isNull() & (F.col("outcome") == "UNRESOLVED"), "keep"), (F.col("master_symbol").isNull(), "ask"), (F.coalesce(agrees, F.lit(False)), "keep"), otherwise="adopt")
    return out.withColumn("action", action)


def report(ledger: DataFrame, by: str) -> DataFrame:
    """(by, category, n) with all categories, none left out, in long form for a measurement report."""
    spark = ledger.sparkSession
    cells = ledger.select(by).distinct().join(F.broadcast(spark.createDataFrame([(g, i) for i, g in enumerate(GRADES)], "category string, place int")), F.lit(True))
    return cells.join(ledger.groupBy(by, "category").agg(F.count("*").alias("n")), [by, "category"], "left").select(by, "category", "place", F.coalesce("n", F.lit(0)).alias("n"))


def digest(movers: DataFrame, newest: DataFrame, flags: DataFrame, n: int = 6) -> DataFrame:
    """(section, nth, id, text) of a digest: what moved most, what is new, what is flagged; at most n of each."""
    out = None
    for section, df, text, order in (("movers", movers, F.format_string("%+.1f", F.col("delta").cast("double")), F.desc(F.abs("delta"))), ("new", newest, F.col("company"), F.desc("seen_at")), ("flags", flags, F.col("code"), F.asc("code"))):
        top = df.orderBy(order, "id").limit(n)
        one = top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(order, "id")).alias("nth"), "id", text.cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
