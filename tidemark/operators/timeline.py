"""What changed between consecutive snapshots of an entity, and which changes matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import pick
from tidemark.operators.ranked import with_previous


def changed_keys(before: Column, after: Column) -> Column:
    """Sorted keys of two maps whose values differ, or that only one has."""
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(before), F.map_keys(after))))
    return F.filter(keys, lambda k: ~F.element_at(before, k).eqNullSafe(F.element_at(after, k)))


def drivers(before: Column, after: Column, least: float = 1.0, most: int = 6) -> Column:
    """array<struct<pillar, delta>>: what moved by least or more in both maps, largest moves first."""
    both = F.map_zip_with(before, after, lambda k, a, b: F.round(b - a, 1))
    moved = F.filter(F.map_entries(both), lambda e: F.abs(e["value"]) >= least)
    ordered = F.array_sort(F.transform(moved, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("pillar"), e["value"].alias("delta"))))
    return F.slice(F.transform(ordered, lambda e: F.struct(e["pillar"].alias("pillar"), e["delta"].alias("delta"))), 1, most)


def timeline(snapshots: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Snapshots (overall, pillars map, features map, recommendation, version, event) with what changed since the one before."""
    s = with_previous(snapshots, [key], ts, tie, ["overall", "pillars", "features", "recommendation", "version"])
    first = F.col("nth") == 1
    return s.withColumns(
        {
            "delta": F.when(~first, F.round(F.col("overall") - F.col("prev_overall"), 1)),
            "drivers": F.when(~first, drivers(F.col("prev_pillars"), F.col("pillars"))),
            "changed": F.when(~first, F.slice(changed_keys(F.col("prev_features"), F.col("features")), 1, 8)),
            "version_change": F.when(~first & (F.col("version") != F.col("prev_version")), F.concat_ws(" -> ", "prev_version", "version")),
            "recommendation_change": F.when(~first & (F.col("recommendation") != F.col("prev_recommendation")), F.concat_ws(" -> ", "prev_recommendation", "recommendation")),
        }
    )


def material(df: DataFrame, gate: float = 70.0) -> DataFrame:
    """Adds kind: whether a snapshot is news. Needs overall, listing, long_term, confidence, recommendation, valuation_label
    and their prev_ columns, and nth."""
    c = F.col
    move = lambda x, n: F.abs(c(x) - c(f"prev_{x}")) >= n
    kind = pick(
        (c("recommendation").contains("NO RECOMMENDATION"), None),
        (c("nth") == 1, F.when((c("confidence") >= gate) & (c("overall") >= 60), "score")),
        (c("recommendation") != c("prev_recommendation"), "recommendation"),
        ((c("valuation_label") != c("prev_valuation_label")) & (c("valuation_label") != "INSUFFICIENT DATA"), "valuation"),
        (move("overall", 5) | move("listing", 7) | move("long_term", 7), "score"),
    )
    return df.withColumn("kind", kind)


def event_stage(df: DataFrame) -> DataFrame:
    """Adds event: the one thing that a snapshot documents; null if it documents nothing. Needs status, final_price,
    filing_url, price_low, price_high, anchor_quality, total_sub, overall, recommendation, their prev_ columns, and nth."""
    c = F.col
    changed = lambda x: ~c(x).eqNullSafe(c(f"prev_{x}"))
    told = c("recommendation") != c("prev_recommendation")
    moved = F.coalesce(told | (F.abs(c("overall") - c("prev_overall")) >= 0.1), F.lit(True))
    stage = pick(
        (c("nth") == 1, "ipo_discovered"),
        (changed("status") & c("status").isin("Listed", "Withdrawn", "Not IPO"), "status_changed"),
        (changed("final_price") & F.nullif(c("prev_final_price"), F.lit(0.0)).isNull() & (F.lower("status") != "listed"), "final_pre_listing"),
        (changed("filing_url"), F.when(F.coalesce(c("prev_filing_url"), F.lit("")) == "", "filing_ingested").otherwise("filing_amendment")),
        (changed("price_low") | changed("price_high"), "price_band_set"),
        (changed("status"), "status_changed"),
        (changed("anchor_quality"), F.when(moved, "anchor_data_added")),
        (changed("total_sub"), F.when(moved, "subscription_update")),
        (told, "recommendation_changed"),
        (moved, "material_score_change"),
    )
    return df.withColumn("event", stage)


def movers(df: DataFrame, key: str, ts: str, tie: str, value: str, least: float = 5.0, most: int = 6) -> DataFrame:
    """The largest moves between each key's last two rows."""
    s = with_previous(df, [key], ts, tie, [value])
    last = s.groupBy(key).agg(F.max_by(F.struct(value, f"prev_{value}"), F.struct(ts, tie)).alias("_l"))
    d = last.select(key, (F.col(f"_l.{value}") - F.col(f"_l.prev_{value}")).alias("delta")).filter(F.abs("delta") >= least)
    return d.orderBy(F.desc(F.abs("delta")), F.asc(key)).limit(most)
