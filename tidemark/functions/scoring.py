"""The composite score: pillars, weighted totals, a confidence gate and what it says, in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import basic as b
from tidemark.functions.basic import linear, mean_known, pick, ratio, truthy

# Fixed values of the scoring model.
WEIGHTS = {
    "overall": {"business": 0.12, "growth": 0.12, "financial": 0.16, "valuation": 0.18, "issue": 0.09, "governance": 0.09, "demand": 0.10, "market": 0.07, "confidence": 0.07},
    "listing_india": {"demand": 0.34, "valuation": 0.16, "gmp": 0.14, "market": 0.14, "growth": 0.07, "financial": 0.05, "confidence": 0.10},
    "listing_us": {"valuation": 0.27, "demand": 0.18, "market": 0.18, "growth": 0.12, "financial": 0.10, "confidence": 0.15},
    "long_term": {"business": 0.17, "growth": 0.18, "financial": 0.19, "valuation": 0.19, "governance": 0.10, "issue": 0.07, "market": 0.04, "confidence": 0.06},
}
DEMAND_INDIA = {"qib_sub": 0.38, "nii_sub": 0.17, "retail_sub": 0.13, "total_sub": 0.17}
ANCHOR_SHARE = 0.15
PRIMARY_HOSTS = ("sec.gov", "nseindia.com", "sebi.gov.in")
ACTIVE = ("Filed", "Upcoming", "Open", "Closed", "Priced")
EVIDENCE = ("price_high", "revenue_m", "revenue_prev_m", "net_income_m", "cfo_m", "debt_m", "cash_m", "post_issue_shares_m")
GRACE_DAYS, STALE_DAYS, STALE_PENALTY = 7, 60, 0.12
UNDERPRICED, FAIR = 72, 45
NO_VALUATION = "INSUFFICIENT DATA"
GATE = 70.0


def is_india(country: Column) -> Column:
    return F.lower(country) == "india"


def primary_source(url: Column) -> Column:
    """Whether a URL's host is a regulator's or exchange's, or below one; malformed or missing ones are not."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(reduce(lambda x, y: x | y, ((host == h) | host.endswith("." + h) for h in PRIMARY_HOSTS)), F.lit(False))


def valuation(px: Column, shares: Column, net_income: Column, revenue: Column, peer_pe: Column, peer_ps: Column) -> dict[str, Column]:
    """Multiples against peers: score, label, and a fair range of ten percent around the implied price."""
    cap = px * truthy(shares)
    pe = F.when(net_income > 0, ratio(cap, net_income))
    ps = F.when(revenue > 0, ratio(cap, revenue))
    against = [ratio(truthy(pe), truthy(peer_pe)), ratio(truthy(ps), truthy(peer_ps))]
    points = [b.between(100 - (r - 0.65) * 100, 0, 100) for r in against]
    known = against[0].isNotNull() | against[1].isNotNull()
    score = mean_known(*points)
    fair = F.when(known, mean_known(*[ratio(px, r) for r in against]))
    label = pick((~known, NO_VALUATION), (score >= UNDERPRICED, "UNDERPRICED"), (score >= FAIR, "FAIR"), otherwise="OVERPRICED")
    return {"valuation": score, "valuation_label": label, "fair_low": truthy(fair) * 0.9, "fair_high": truthy(fair) * 1.1, "implied_pe": pe, "implied_ps": ps}


def staleness(status: Column, age_days: Column) -> Column:
    """What confidence loses for an active record that nobody refreshed: nothing in the grace days, then a line."""
    late = F.lit(STALE_PENALTY) * (age_days - GRACE_DAYS) / float(STALE_DAYS - GRACE_DAYS)
    return F.when(status.isin(*ACTIVE) & (age_days > GRACE_DAYS), F.least(F.lit(STALE_PENALTY), late)).otherwise(0.0)


def confidence(flags: Column, conflicts: Column) -> Column:
    """0 to 100, from how many of ten inputs are known, the source, flags, conflicts and age of the record."""
    tenth = F.when(is_india(F.col("country")), F.col("fresh_issue_pct").isNotNull()).otherwise(F.col("lockup_days").isNotNull())
    known = [F.col(c).isNotNull() for c in EVIDENCE] + [b.text_or_null(F.col("filing_url")).isNotNull(), tenth]
    complete = reduce(lambda x, y: x + y, (k.cast("int") for k in known)) / len(known)
    counted = F.size(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: ~f.startswith("ipo_classification")))
    share = complete * 0.68 + F.when(primary_source(F.col("filing_url")), 1.0).otherwise(0.72) * 0.32
    lost = F.least(F.lit(0.28), counted * 0.035) + F.least(F.lit(0.25), F.coalesce(conflicts, F.lit(0)) * 0.08) + staleness(F.col("status"), F.col("age_days"))
    return b.between((share - lost) * 100, 0, 100)


def _weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda x, y: x + y, (F.col(f"p_{k}") * w for k, w in weights.items()))


def pillars(df: DataFrame) -> DataFrame:
    """Adds p_business to p_confidence (0 to 100 each), the grey-market pillar and the valuation columns."""
    c = F.col
    india = is_india(c("country"))
    value = valuation(b.price_of(c("final_price"), c("price_high")), c("post_issue_shares_m"), c("net_income_m"), c("revenue_m"), c("peer_median_pe"), c("peer_median_ps"))
    # what has no growth at all is averaged to the neutral 50 first, which the line from -10 to 35 then makes 100
    grown = linear(mean_known(b.growth_pct(c("revenue_m"), c("revenue_prev_m")), b.growth_pct(c("revenue_prev_m"), c("revenue_2y_ago_m"))), -10, 35)
    debt = F.when(c("debt_m").isNotNull() | c("cash_m").isNotNull(), F.coalesce(c("debt_m"), F.lit(0.0)) - F.coalesce(c("cash_m"), F.lit(0.0)))
    leverage = F.when(c("ebitda_m") > 0, ratio(debt, c("ebitda_m")))
    margin = lambda x: ratio(c(x), c("revenue_m")) * 100
    financial = mean_known(
        linear(margin("ebitda_m"), 0, 25),
        linear(margin("net_income_m"), -5, 15),
        linear(margin("cfo_m"), -5, 18),
        linear(F.when(c("net_income_m") > 0, ratio(c("cfo_m"), c("net_income_m"))), 0, 1.2),
        F.coalesce(100 - F.when(leverage.isNotNull(), linear(leverage, 0, 4)), F.lit(55.0)),
    )
    votes = F.when(c("dual_class").isNull(), b.NEUTRAL).when(c("dual_class"), 35.0).otherwise(70.0)
    demand_india = reduce(lambda x, y: x + y, (b.subscription(c(k)) * w for k, w in DEMAND_INDIA.items())) + b.five_star(c("anchor_quality")) * ANCHOR_SHARE
    demand_us = mean_known(b.five_star(c("underwriter_quality")), linear(c("shares_offered_m"), 30, 2))
    return df.withColumns(
        value
        | {
            "p_business": F.lit(b.NEUTRAL),
            "p_growth": grown,
            "p_financial": financial,
            "p_issue": mean_known(linear(c("fresh_issue_pct"), 0, 80), 100 - linear(c("ofs_pct"), 0, 100)),
            "p_demand": F.when(india, demand_india).otherwise(demand_us),
            "p_governance": F.when(india, mean_known(linear(c("promoter_retention_pct"), 35, 75), votes)).otherwise(votes),
            "p_gmp": F.when(india, linear(c("gmp_pct"), -10, 40)).otherwise(b.NEUTRAL),
            "p_market": mean_known(b.five_star(c("market_regime")), b.five_star(c("sector_regime"))),
            "p_confidence": confidence(c("data_flags"), c("conflicts")),
        }
    ).withColumnRenamed("valuation", "p_valuation")


def totals(df: DataFrame) -> DataFrame:
    india = is_india(F.col("country"))
    out = df.withColumns({"overall": _weighted(WEIGHTS["overall"]), "long_term": _weighted(WEIGHTS["long_term"]), "listing": F.when(india, _weighted(WEIGHTS["listing_india"])).otherwise(_weighted(WEIGHTS["listing_us"]))})
    return out.withColumns({"listing_probability": b.logistic(F.col("listing"), 64, 9), "long_term_probability": b.logistic(F.col("long_term"), 67, 10)})


def verdict(df: DataFrame, gate: float = GATE, strict: bool = True) -> DataFrame:
    """recommendation and horizon; below the gate nothing is recommended."""
    o, li, lo = F.col("overall"), F.col("listing"), F.col("long_term")
    shut = F.lit(strict) & (F.col("p_confidence") < gate)
    return df.withColumns(
        {
            "recommendation": pick((shut, "INSUFFICIENT RELIABLE DATA: NO RECOMMENDATION"), ((o >= 80) & (lo >= 74), "INVEST: STRONG"), (o >= 70, "INVEST SELECTIVELY"), (o >= 60, "WATCH / SMALL ALLOCATION"), otherwise="AVOID / WAIT"),
            "horizon": pick(
                (shut, "WAIT FOR VERIFIED DATA"), ((li >= 74) & (lo < 65), "LISTING GAINS ONLY"), ((li >= 70) & (lo >= 72), "BOTH: LISTING + LONG TERM"),
                ((lo >= 74) & (li < 65), "LONG TERM: WAIT FOR PRICE DISCOVERY"), (lo >= 68, "LONG TERM BIAS"), (li >= 68, "LISTING BIAS"), otherwise="NO CLEAR EDGE",
            ),
        }
    )


def arguments(df: DataFrame, gate: float = GATE) -> DataFrame:
    """What speaks for, what against, and what would change the verdict: short codes, in order."""
    c = F.col
    return df.withColumns(
        {
            "rationale": b.listed((c("p_growth") >= 70, "strong_growth"), (c("p_financial") >= 70, "sound_financials"), (c("p_valuation") >= 72, "attractive_valuation"), (c("p_demand") >= 72, "strong_demand"), most=6),
            "risks": b.listed(
                (c("p_valuation") < 42, "aggressive_valuation"), (c("p_financial") < 45, "weak_financials"), (c("p_confidence") < 70, "thin_data"), (c("ofs_pct") > 65, "sellers_exit"),
                (c("dual_class"), "dual_class"), (c("total_sub") < 1, "undersubscribed"), most=8,
            ),
            "changes": b.listed(
                (c("valuation_label") == NO_VALUATION, "peer_set"), (c("cfo_m").isNull(), "cash_flow"), (is_india(c("country")) & c("qib_sub").isNull(), "qib_demand"), (c("p_confidence") < gate, "confidence"), most=8,
            ),
        }
    )


def confidence_reasons(df: DataFrame) -> DataFrame:
    """Why confidence is what it is, read off the same inputs."""
    c = F.col
    statements = {"revenue": "revenue_m", "prior-year revenue": "revenue_prev_m", "net income": "net_income_m", "operating cash flow": "cfo_m", "debt": "debt_m", "cash": "cash_m"}
    gone = b.listed(*[(c(col).isNull(), name) for name, col in statements.items()])
    india = is_india(c("country"))
    no_url = b.text_or_null(c("filing_url")).isNull()
    flags = F.filter(F.coalesce(c("data_flags"), F.array().cast("array<string>")), lambda f: ~f.startswith("ipo_classification"))
    reasons = b.listed(
        (no_url, "no filing"), (~no_url & ~primary_source(c("filing_url")), "secondary source"), (c("price_high").isNull(), "no price"),
        (F.size(gone) >= 4, F.concat(F.lit("statements incomplete: "), F.array_join(gone, ", "))), (F.size(gone).between(1, 3), F.concat(F.lit("missing: "), F.array_join(gone, ", "))),
        (c("post_issue_shares_m").isNull(), "no share count"), (c("post_issue_shares_m").isNotNull() & truthy(c("peer_median_pe")).isNull() & truthy(c("peer_median_ps")).isNull(), "no peers"),
        (india & c("fresh_issue_pct").isNull(), "no issue split"), (~india & c("lockup_days").isNull(), "no lock-up terms"), (c("market_regime").isNull(), "no market regime"),
        (staleness(c("status"), c("age_days")) > 0, "stale record"), (c("conflicts") > 0, F.concat(c("conflicts").cast("string"), F.lit(" conflicting fields"))),
    )
    return df.withColumn("confidence_reasons", F.concat(reasons, flags))


def score(df: DataFrame, gate: float = GATE) -> DataFrame:
    """All of the above over a frame of issues."""
    return arguments(verdict(totals(pillars(df)), gate), gate)
