"""What would change a verdict: the value of one input at which the recommendation gets better or worse.

An interval is halved 24 times, as a search that asks at each middle whether the verdict differs. Six halvings are one pass:
the score runs over the 63 places that they could ask at, for all rows and inputs at once, and the answers are walked as
the halvings would. So four passes of plain expressions give what 24 dependent ones would, whatever the answers."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import price_of
from tidemark.functions.scoring import is_india
from tidemark.sources.sinks import kept

#: Fixed: recommendations from best to worst.
BANDS = ("INVEST: STRONG", "INVEST SELECTIVELY", "WATCH / SMALL ALLOCATION", "AVOID / WAIT", "INSUFFICIENT RELIABLE DATA: NO RECOMMENDATION")
#: Halvings of a pass, and passes.
STEPS, PASSES = 6, 4


class Lever(NamedTuple):
    """An input that is moved from low to high to look for a better (or worse) verdict; told: whether a found value (second
    argument) is far enough from today's (first) to be worth telling."""

    name: str
    column: str
    better: bool
    now: Callable[[], Column]
    low: Callable[[Column], Column]
    high: Callable[[Column], Column]
    told: Callable[[Column, Column], Column]
    asked: Callable[[], Column] = lambda: F.lit(True)


def _c(name: str) -> Column:
    return F.col(name)


# Fixed: how far each input may move, and from what change on it is told.
LEVERS = [
    Lever("valuation", "final_price", True, lambda: price_of(_c("final_price"), _c("price_high")), lambda x: x * 0.5, lambda x: x, lambda x, v: (1 - v / x) * 100 > 0.5),
    Lever("valuation", "final_price", False, lambda: price_of(_c("final_price"), _c("price_high")), lambda x: x, lambda x: x * 1.8, lambda x, v: (v / x - 1) * 100 > 0.5),
    Lever("qib_demand", "qib_sub", True, lambda: F.coalesce(F.nullif(_c("qib_sub"), F.lit(0.0)), F.lit(0.5)), lambda x: x, lambda x: F.lit(100.0), lambda x, v: v > x + 0.5, lambda: is_india(_c("country"))),
    Lever("qib_demand", "qib_sub", False, lambda: F.coalesce(F.nullif(_c("qib_sub"), F.lit(0.0)), F.lit(0.5)), lambda x: F.lit(0.0), lambda x: x, lambda x, v: v < x - 0.2, lambda: is_india(_c("country"))),
    Lever("underwriter", "underwriter_quality", True, lambda: F.coalesce(_c("underwriter_quality"), F.lit(2.5)), lambda x: x, lambda x: F.lit(5.0), lambda x, v: v > x + 0.3, lambda: ~is_india(_c("country"))),
    Lever("market", "market_regime", True, lambda: F.coalesce(_c("market_regime"), F.lit(2.5)), lambda x: x, lambda x: F.lit(5.0), lambda x, v: v > x + 0.3),
    Lever("market", "market_regime", False, lambda: F.coalesce(_c("market_regime"), F.lit(2.5)), lambda x: F.lit(0.0), lambda x: x, lambda x, v: v < x - 0.3),
    Lever("structure", "ofs_pct", False, lambda: _c("ofs_pct"), lambda x: x, lambda x: F.lit(100.0), lambda x, v: v > x + 3),
    Lever("cash", "cfo_m", True, lambda: _c("cfo_m"), lambda x: x, lambda x: _c("revenue_m") * 0.4, lambda x, v: v > x * 1.15, lambda: F.nullif(_c("revenue_m"), F.lit(0.0)).isNotNull()),
]


def band_rank(recommendation: Column) -> Column:
    return F.coalesce(*[F.when(recommendation == b, i) for i, b in enumerate(BANDS)], F.lit(len(BANDS)))


def thresholds(df: DataFrame, id_col: str, rank: Callable[[DataFrame], DataFrame], levers: list[Lever] = LEVERS) -> DataFrame:
    """(id, lever, direction, now, value): for each row and lever with a flip worth telling, today's value and the one at
    which the rank first differs, to two digits. rank adds a column rank (0 is best) to rows with df's columns; id_col is
    unique. A lever whose value is null isn't asked."""
    kinds = dict(df.dtypes)
    base = kept(rank(df).select(*df.columns, F.col("rank").alias("_base")))
    asked = F.array_compact(F.array(*[
        F.when(x.asked() & x.now().isNotNull(), F.struct(F.lit(i).alias("n"), F.lit(x.better).alias("better"), x.now().cast("double").alias("now"), x.low(x.now()).cast("double").alias("low"), x.high(x.now()).cast("double").alias("high")))
        for i, x in enumerate(levers)
    ]))
    rows = base.select(id_col, F.explode(asked).alias("l")).select(id_col, "l.*").filter("now <> 0 and low is not null and high is not null")

    def differs(moved: DataFrame, value: Column) -> DataFrame:
        """moved (id, n, ...) with flips: whether the rank at value is on the asked side of today's."""
        own = [c for c in moved.columns if c != id_col]
        j = moved.withColumn("_v", value).select(id_col, F.struct(*own, "_v").alias("_m")).join(base, id_col)
        for c in {x.column for x in levers}:
            mine = F.col("_m.n").isin(*[i for i, x in enumerate(levers) if x.column == c])
            j = j.withColumn(c, F.when(mine, F.col("_m._v").cast(kinds[c])).otherwise(F.col(c)))
        flips = F.when(F.col("_m.better"), F.col("rank") < F.col("_base")).otherwise(F.col("rank") > F.col("_base"))
        return rank(j).select(id_col, *[F.col(f"_m.{c}").alias(c) for c in own], flips.alias("flips"))

    hits = differs(rows, F.col("high")).filter("flips").drop("flips")
    hits = kept(hits.select(id_col, "n", "better", "now", F.when(F.col("better"), F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("better"), F.col("high")).otherwise(F.col("low")).alias("b")))
    places = 1 << STEPS
    for _ in range(PASSES):
        tried = hits.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(places - 1))))
        told = differs(tried, F.col("a") + (F.col("b") - F.col("a")) * F.col("j") / places)
        flags = F.transform(F.array_sort(F.collect_list(F.struct("j", "flips"))), lambda x: x["flips"])

        def step(box: Column, _: Column) -> Column:
            middle = ((box["a"] + box["b"]) / 2).cast("int")
            flipped = F.element_at("_f", middle)
            return F.struct(F.when(flipped, box["a"]).otherwise(middle).alias("a"), F.when(flipped, middle).otherwise(box["b"]).alias("b"))

        walked = told.groupBy(id_col, "n", "better", "now", "a", "b").agg(flags.alias("_f")).withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0).alias("a"), F.lit(places).alias("b")), step))
        at = lambda k: F.col("a") + (F.col("b") - F.col("a")) * F.col(f"w.{k}") / places
        hits = kept(walked.select(id_col, "n", "better", "now", at("a").alias("a"), at("b").alias("b")))
    value = F.round("b", 2)
    worth = F.coalesce(*[F.when(F.col("n") == i, x.told(F.col("now"), value)) for i, x in enumerate(levers)])
    name = F.element_at(F.array(*[F.lit(x.name) for x in levers]), F.col("n") + 1)
    return hits.filter(worth).select(id_col, name.alias("lever"), F.when(F.col("better"), "better").otherwise("worse").alias("direction"), "now", value.alias("value"))
