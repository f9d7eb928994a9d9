"""Discounted cash flows: three scenarios, the growth that a price implies, and what would flip a verdict."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import basic as b
from tidemark.functions.scoring import is_india

# Scenario to (share of base growth, discount rate); years; what of EBITDA is left before tax; tax; investment.
SCENARIOS = {"bear": (0.55, 0.13), "base": (1.00, 0.11), "bull": (1.45, 0.10)}
YEARS, BEFORE_TAX, AFTER_TAX, INVESTED = 5, 0.82, 0.75, 0.06
DEFAULT_GROWTH = 0.15
LOW_GROWTH, HIGH_GROWTH, HALVINGS = -0.3, 3.0, 60


def enterprise_value(revenue: Column, growth: Column, margin: Column, margin_end: Column, wacc: Column, terminal: Column) -> Column:
    """Five years of free cash flow and a terminal value, unrolled: no loop runs per row."""
    flows = []
    for y in range(1, YEARS + 1):
        sales = revenue * F.pow(1 + growth, F.lit(y))
        flows.append(sales * ((margin + (margin_end - margin) * (y / YEARS)) * BEFORE_TAX * AFTER_TAX - INVESTED))
    present = reduce(lambda x, z: x + z, (f / F.pow(1 + wacc, F.lit(y)) for y, f in enumerate(flows, 1)))
    last = flows[-1] * (1 + terminal) / (wacc - terminal) / F.pow(1 + wacc, F.lit(YEARS))
    return F.when((revenue > 0) & (wacc > terminal), present + last)


def base_margin() -> Column:
    return b.between(b.ratio(F.col("ebitda_m"), F.col("revenue_m")), -0.5, 0.6)


def base_growth() -> Column:
    return F.when(b.truthy(F.col("revenue_m")).isNotNull(), b.between(b.ratio(F.col("revenue_m"), F.col("revenue_prev_m")) - 1, -0.5, 2.0))


def net_cash() -> Column:
    return F.coalesce(F.col("cash_m"), F.lit(0.0)) - F.coalesce(F.col("debt_m"), F.lit(0.0))


def _inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({"_m": base_margin(), "_g": base_growth(), "_px": b.price_of(F.col("final_price"), F.col("price_high"))})


def scenarios(df: DataFrame) -> DataFrame:
    """Adds available and, for bear, base and bull, ev, equity, fair value per share and upside in percent."""
    df = _inputs(df).withColumn("available", F.coalesce((F.col("revenue_m") > 0) & F.col("_m").isNotNull(), F.lit(False)))
    m = F.col("_m")
    # the bear's target equals today's margin wherever that is positive: kept as the model has it
    ends = {"bear": F.greatest(m, m * 0.85), "base": F.greatest(m + 0.03, m), "bull": m + 0.08}
    terminal = F.when(is_india(F.col("country")), 0.04).otherwise(0.03)
    shares = b.truthy(F.col("post_issue_shares_m"))
    out = {}
    for name, (part, wacc) in SCENARIOS.items():
        growth = F.greatest(F.coalesce(F.col("_g"), F.lit(DEFAULT_GROWTH)) * part, F.lit(-0.1))
        ev = F.when(F.col("available"), enterprise_value(F.col("revenue_m"), growth, m, b.between(ends[name], -0.3, 0.45), F.lit(wacc), terminal))
        equity = ev + net_cash()
        fair = equity / shares
        out |= {f"{name}_ev": ev, f"{name}_equity": equity, f"{name}_fair": fair, f"{name}_upside": (b.ratio(b.truthy(fair), b.truthy(F.col("_px"))) - 1) * 100}
    return df.withColumns(out | {"market_cap": F.col("_px") * shares}).drop("_m", "_g", "_px")


@F.pandas_udf(T.DoubleType())
def _halved(revenue: pd.Series, start: pd.Series, end: pd.Series, wacc: pd.Series, terminal: pd.Series, goal: pd.Series) -> pd.Series:
    """The growth at which a value meets its goal, for a batch of rows at once. A value is a polynomial of 1 + growth whose
    factors don't change while the interval is halved."""
    factors = [revenue * ((start + (end - start) * (y / YEARS)) * BEFORE_TAX * AFTER_TAX - INVESTED) / (1 + wacc) ** y for y in range(1, YEARS + 1)]
    factors[-1] = factors[-1] * (1 + (1 + terminal) / (wacc - terminal))
    low, high = pd.Series(LOW_GROWTH, revenue.index), pd.Series(HIGH_GROWTH, revenue.index)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        below = sum(f * (1 + mid) ** y for y, f in enumerate(factors, 1)) < goal
        low, high = mid.where(below, low), high.where(below, mid)
    return (low + high) / 2


def implied_growth(df: DataFrame) -> DataFrame:
    """Adds the yearly growth that today's price needs, by halving an interval for many rows at once, and how far that reaches."""
    df = _inputs(df)
    india, m = is_india(F.col("country")), F.col("_m")
    some = F.coalesce(b.truthy(m), F.lit(0.10))
    end = F.least(F.lit(0.40), F.greatest(some, some + 0.05))
    cap = F.col("_px") * F.col("post_issue_shares_m")
    df = df.withColumns({"_end": end, "_cap": cap, "_wacc": F.when(india, 0.13).otherwise(0.11), "_t": F.when(india, 0.04).otherwise(0.03), "_goal": cap - net_cash()})
    df = df.withColumn("_start", F.coalesce(b.truthy(m), F.col("_end")))
    known = F.col("_cap").isNotNull() & (F.col("revenue_m") > 0)
    df = df.withColumn("implied_cagr", F.when(known, _halved(*[F.col(c).cast("double") for c in ("revenue_m", "_start", "_end", "_wacc", "_t", "_goal")])))
    i, g = F.col("implied_cagr"), F.col("_g")
    gap = F.when(i > 0.35, 2).when(i > 0.22, 1).otherwise(0) + F.when(i > g * 1.5, 2).when(i > g * 1.15, 1).otherwise(0) + F.when(F.col("_end") > F.coalesce(m, F.lit(0.0)) + 0.10, 1).otherwise(0)
    label = F.when(i.isNull(), "INSUFFICIENT DATA").when(gap >= 4, "EXTREME").when(gap >= 3, "HIGH").when(gap >= 1, "MODERATE").otherwise("LOW")
    return df.withColumns({"margin_end": F.col("_end"), "historical_growth": g, "expectations_gap": label}).drop("_m", "_g", "_px", "_end", "_cap", "_wacc", "_t", "_goal", "_start")


def missing_inputs(**groups: list[str]) -> Column:
    """Names of inputs that are absent or zero; an input may have several columns, any of which will do."""
    return b.listed(*[(F.coalesce(*[b.truthy(F.col(c).cast("double")) for c in cols]).isNull(), " or ".join(cols)) for cols in groups.values()])
