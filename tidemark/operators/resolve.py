"""Which records mean the same thing: keys by priority, masters, intervals, conflicts between sources, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import pick, text_or_null

#: Fixed: how far two sources may differ, and which part of an ISIN names the issuer and the instrument.
TOLERANCE = 0.04
ISSUER_CHARS = 7
EQUITY_TYPE = "01"


def by_priority(items: DataFrame, known: DataFrame, keys: list[str], id_col: str, better: list[Column]) -> DataFrame:
    """items with id_col of the known row that matches on the first of keys that finds one, and which key that was. Of
    several known rows with a key, the first by better (then least id) is meant. An empty key matches nothing."""
    out = items
    order = F.struct(*better, F.col(id_col))
    for i, k in enumerate(keys):
        side = known.filter(text_or_null(F.col(k)).isNotNull()).groupBy(k).agg(F.min_by(id_col, order).alias(f"_id{i}"))
        out = out.join(side, k, "left")
    found = [F.col(f"_id{i}") for i in range(len(keys))]
    by = pick(*[(f.isNotNull(), k) for f, k in zip(found, keys, strict=True)])
    return out.select(*items.columns, F.coalesce(*found).alias("match_id"), by.alias("matched_by"))


def against_master(items: DataFrame, master: DataFrame) -> DataFrame:
    """items (isin, name_key) with outcome and master symbol: by ISIN if one symbol has it, else by name if one symbol has
    it and the ISINs name the same issuer. master: isin, name_key, symbol."""
    one = lambda k, p: master.filter(text_or_null(F.col(k)).isNotNull()).groupBy(k).agg(F.countDistinct("symbol").alias(f"{p}_n"), F.min("symbol").alias(f"{p}_symbol"), F.min_by("isin", F.struct("symbol", "isin")).alias(f"{p}_isin"))
    j = items.join(one("isin", "i").drop("i_isin"), "isin", "left").join(one("name_key", "n"), "name_key", "left")
    own = text_or_null(F.col("isin"))
    same = F.substring("n_isin", 1, ISSUER_CHARS) == F.substring("isin", 1, ISSUER_CHARS)
    outcome = pick(
        (F.col("i_n") == 1, "RESOLVED_ISIN"), (F.col("i_n") > 1, "AMBIGUOUS"), (F.col("n_n").isNull(), "UNRESOLVED"), (F.col("n_n") > 1, "AMBIGUOUS"),
        (own.isNull(), "UNRESOLVED"), (F.coalesce(same, F.lit(False)), "NAME_ISIN_PREFIX"), otherwise="CONFLICTING",
    )
    out = j.withColumn("outcome", outcome)
    symbol = pick((F.col("outcome") == "RESOLVED_ISIN", F.col("i_symbol")), (F.col("outcome") == "NAME_ISIN_PREFIX", F.col("n_symbol")))
    return out.select(*items.columns, "outcome", symbol.alias("master_symbol"))


def equity_of(items: DataFrame, master: DataFrame) -> DataFrame:
    """For ISINs of other instruments: the equity ISIN of the one master row with the same name and issuer, else null."""
    one = master.filter(text_or_null(F.col("name_key")).isNotNull()).groupBy("name_key").agg(F.countDistinct("symbol").alias("_n"), F.min("isin").alias("_isin"))
    j = items.join(one, "name_key", "left")
    fits = (F.length("isin") == 12) & (F.substring("isin", 8, 2) != EQUITY_TYPE) & (F.col("_n") == 1) & (F.substring("_isin", 1, ISSUER_CHARS) == F.substring("isin", 1, ISSUER_CHARS))
    return j.select(*items.columns, F.when(fits, F.col("_isin")).alias("equity_isin"))


def listed_after(live: DataFrame, master: DataFrame, days: int = 30) -> DataFrame:
    """Live issues (symbol, name_key, closed) whose symbol is one master row's, of the same name, that listed within so
    many days of the close: adds listed_on."""
    one = master.groupBy("symbol").agg(F.count("*").alias("_n"), F.min("name_key").alias("_name"), F.min("listed_on").alias("_listed"))
    j = live.join(one, "symbol", "left")
    ok = (F.col("_n") == 1) & (F.col("_name") == F.col("name_key")) & F.datediff("_listed", "closed").between(0, days)
    return j.select(*live.columns, F.when(ok, F.col("_listed")).alias("listed_on"))


def symbol_agrees(items: DataFrame, master: DataFrame) -> DataFrame:
    """agrees: whether some row of the master has the item's ISIN with its symbol, in any case; null where the master lacks the
    ISIN or the item its symbol. Joins with distinct keys, so an ISIN with very many rows gathers nowhere."""
    known = master.filter("isin is not null").select("isin").distinct().withColumn("_known", F.lit(True))
    pairs = master.filter("isin is not null").select("isin", F.upper("symbol").alias("_symbol")).distinct().withColumn("_same", F.lit(True))
    j = items.withColumn("_symbol", F.upper("symbol")).join(known, "isin", "left").join(pairs, ["isin", "_symbol"], "left")
    return j.select(*items.columns, F.when(F.col("_known") & F.col("_symbol").isNotNull(), F.coalesce("_same", F.lit(False))).alias("agrees"))


def past_issue(items: DataFrame, past: DataFrame) -> DataFrame:
    """items matched with past issues by symbol and either the same close or, without one, the same name; unique matches
    only. outcome: unmatched, ambiguous, outside_band (over 5 percent), follow_on (listed over a year off), conflict
    (over 1 percent from a stored price), agrees, filled. items: id, symbol, name_key, closed, price, high, listed_on;
    past: symbol, name_key, closed, price, listed_on."""
    p = past.select("symbol", F.col("name_key").alias("_name"), F.col("closed").alias("_closed"), F.col("price").alias("_price"), F.col("listed_on").alias("_listed"))
    j = items.join(p, "symbol").filter((F.col("closed") == F.col("_closed")) | (F.col("closed").isNull() & (F.col("name_key") == F.col("_name"))))
    one = j.groupBy("id").agg(F.count("*").alias("_n"), F.min(F.struct("_price", "_listed")).alias("_p"))
    out = items.join(one, "id", "left")
    official = F.col("_p._price")
    off = lambda a: F.coalesce(F.abs(F.try_divide(official, a) - 1), F.lit(0.0))
    outcome = pick(
        (F.col("_n").isNull(), "unmatched"), (F.col("_n") > 1, "ambiguous"), (F.coalesce(F.abs(F.datediff("_p._listed", "listed_on")) > 365, F.lit(False)), "follow_on"),
        (off(F.col("high")) > 0.05, "outside_band"), (F.col("price").isNull(), "filled"), (off(F.col("price")) > 0.01, "conflict"), otherwise="agrees",
    )
    return out.select(*items.columns, outcome.alias("outcome"), F.when(F.col("_n") == 1, official).alias("official_price"))


def superseded(active: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows that no listed row of the same keys replaces."""
    return active.join(listed.select(*keys).distinct(), keys, "left_anti")


def conflicts(evidence: DataFrame, keys: list[str], source: str, value: str) -> DataFrame:
    """keys whose sources differ by more than 4 percent: how many sources, least and greatest value, the relative gap.

    A pair differs if the farthest pair does, so sources are summed up to their extremes and no pairs are formed."""
    per = evidence.filter(F.col(value).isNotNull()).groupBy(*keys, source).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # the greatest gap is between some source's least and another's greatest; where one source has both ends, the next
    # best end of another source counts
    gap = lambda x, y: F.abs(y - x) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9))
    ends = per.groupBy(*keys).agg(F.count("*").alias("sources"), F.min(F.struct("lo", source)).alias("a"), F.max(F.struct("hi", source)).alias("b")).filter("sources > 1")
    own, other = F.col(source) == F.col(f"a.{source}"), F.col(f"a.{source}") != F.col(f"b.{source}")
    both = per.join(ends, keys).groupBy(*keys, "sources", "a", "b").agg(F.min(F.when(~own, F.col("lo"))).alias("a2"), F.max(F.when(F.col(source) != F.col(f"b.{source}"), F.col("hi"))).alias("b2"))
    out = both.withColumn("gap", F.when(other, gap(F.col("a.lo"), F.col("b.hi"))).otherwise(F.greatest(gap(F.col("a.lo"), F.col("b2")), gap(F.col("a2"), F.col("b.hi")))))
    return out.filter(F.col("gap") > TOLERANCE).select(*keys, "sources", F.col("a.lo").alias("least"), F.col("b.hi").alias("greatest"), "gap")


def conflicting_pairs(evidence: DataFrame, keys: list[str], id_col: str, source: str, value: str) -> DataFrame:
    """Each pair of rows of the same keys from different sources that differ by more than 4 percent."""
    e = evidence.filter(F.col(value).isNotNull())
    a = e.select(*keys, F.col(id_col).alias("id_a"), F.col(source).alias("source_a"), F.col(value).alias("value_a"))
    b = e.select(*keys, F.col(id_col).alias("id_b"), F.col(source).alias("source_b"), F.col(value).alias("value_b"))
    gap = F.abs(F.col("value_a") - F.col("value_b")) / F.greatest(F.abs("value_a"), F.abs("value_b"), F.lit(1e-9))
    return a.join(b, keys).filter((F.col("id_a") < F.col("id_b")) & (F.col("source_a") != F.col("source_b"))).withColumn("gap", gap).filter(F.col("gap") > TOLERANCE)


def agreement(evidence: DataFrame, keys: list[str], source: str, value: str, a: str, b: str, within: float = 0.01) -> DataFrame:
    """How often two sources give the same keys, and how often within one percent of each other."""
    wide = evidence.filter(F.col(source).isin(a, b)).groupBy(*keys).agg(F.max(F.when(F.col(source) == a, F.col(value))).alias("a"), F.max(F.when(F.col(source) == b, F.col(value))).alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= F.lit(within) * F.greatest(F.abs("a"), F.abs("b"))
    both = wide.filter("a is not null and b is not null")
    return both.agg(F.count("*").alias("pairs"), F.count_if(near).alias("agree"))


def periods_between(observed: DataFrame, entity: str, field: str, period: str, source: str, value: str, a: str, b: str, within: float = 0.01, stale: int | None = None) -> DataFrame:
    """(field, both, a_leads, b_leads, same_newest, stale, same_period, agree): of the entities for which both sources tell a
    field, whose newest period is the later one, how many newest periods lie more than ``stale`` days apart (null without
    it), and of periods that both tell, how many values agree within a share.

    One pass: a row per entity, field and period with both values, then one per entity and field with both newest periods, so
    neither a join nor a window is needed. Of observations that repeat the greatest value counts; a period without a value still counts as one that was told."""
    own = lambda s: F.col(source) == s
    per = observed.filter(F.col(source).isin(a, b)).groupBy(entity, field, period).agg(*[F.max(F.when(own(s), F.col(value))).alias(n) for s, n in ((a, "a"), (b, "b"))], *[F.bool_or(own(s)).alias(n) for s, n in ((a, "has_a"), (b, "has_b"))])
    near = F.abs(F.col("a") - F.col("b")) <= F.lit(within) * F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-9))
    newest = per.groupBy(entity, field).agg(F.max(F.when(F.col("has_a"), F.col(period))).alias("of_a"), F.max(F.when(F.col("has_b"), F.col(period))).alias("of_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"), F.count_if(near).alias("agree"))
    apart = F.count_if(F.abs(F.datediff(F.col("of_a").cast("date"), F.col("of_b").cast("date"))) > stale) if stale is not None else F.lit(None).cast("long")
    both = newest.filter("of_a is not null and of_b is not null").groupBy(field)
    return both.agg(F.count("*").alias("both"), F.count_if(F.col("of_a") > F.col("of_b")).alias("a_leads"), F.count_if(F.col("of_b") > F.col("of_a")).alias("b_leads"), F.count_if(F.col("of_a") == F.col("of_b")).alias("same_newest"), apart.alias("stale"), F.sum("same").alias("same_period"), F.sum("agree").alias("agree"))


def merged(old: DataFrame, new: DataFrame, key: str, rank: Column | None = None) -> DataFrame:
    """old and new by key: what new has replaces what old had, but nothing never replaces something. With columns status
    in both, a status doesn't go back (rank: a function of a status column)."""
    from tidemark.functions.rules import may_become

    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    j = old.join(n, key, "full_outer")
    kinds = dict(old.dtypes)

    def value(c: str) -> Column:
        fresh = F.nullif(F.col(f"_n_{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"_n_{c}")
        if c == "status":
            return F.when(may_become(F.col("status"), fresh), fresh).otherwise(F.col("status")).alias(c)
        return F.coalesce(fresh, F.col(c)).alias(c)

    return j.select(key, *[value(c) if f"_n_{c}" in j.columns else F.col(c) for c in old.columns if c != key])


def new_rows(have: DataFrame, rows: DataFrame, wanted: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """rows of wanted entities that aren't stored yet: an insert that may be repeated."""
    return rows.join(wanted.select(entity).distinct(), entity, "left_semi").join(have.select(*keys).distinct(), keys, "left_anti")


def filled(current: DataFrame, observations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with its null fields filled from the latest observation (key, field, period_end, value) of each."""
    last = observations.groupBy(key).agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when((F.col("field") == f) & F.col("value").isNotNull(), F.col("period_end"))).alias(f"_{f}") for f in fields])
    return current.join(last, key, "left").select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in current.columns])


def first_found(items: DataFrame, series: DataFrame, candidates: str, key: str, id_col: str) -> DataFrame:
    """For each item the first of its candidate keys that a series has."""
    have = series.select(F.col(key).alias("_k")).distinct()
    asked = items.select(id_col, F.posexplode(candidates).alias("_pos", "_k")).join(have, "_k", "left_semi")
    return items.join(asked.groupBy(id_col).agg(F.min_by("_k", "_pos").alias("series_key")), id_col, "left")


def unchanged(flags: Column, prefix: str, new: Column) -> Column:
    """flags without those of a prefix, and new in their place if it isn't null."""
    kept = F.filter(flags, lambda f: ~f.startswith(prefix))
    return F.when(new.isNull(), kept).otherwise(F.array_append(kept, new))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
