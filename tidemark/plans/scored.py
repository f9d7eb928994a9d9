"""Queries of the scoring family: composite score, confidence, verdicts, flags, contradictions, cash flows, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, rules, scoring, valuation
from tidemark.functions.basic import steady
from tidemark.operators import ranked, sensitivity, summaries, timeline
from tidemark.plans.base import ISSUES_SQL, issues, query, r4, table

# ---- the model as SQL -----------------------------------------------------------------------------------------------


def _clamp(x: str, lo: str, hi: str) -> str:
    """Null stays null, which greatest and least would lose."""
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"


def _lin(x: str, lo: float, hi: float) -> str:
    return f"coalesce({_clamp(f'(({x}) - ({lo})) / ({hi - lo}) * 100', '0', '100')}, 50.0)"


def _avg(*xs: str) -> str:
    n, s = (" + ".join(f(x) for x in xs) for f in (lambda x: f"(CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END)", lambda x: f"coalesce({x}, 0)"))
    return f"coalesce(({s}) / nullif({n}, 0), 50.0)"


def _five(x: str) -> str:
    return f"coalesce({_clamp(f'({x}) * 20', '0', '100')}, 50.0)"


def _sub(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 50 WHEN {x} < 1 THEN greatest(10, 35 * {x}) WHEN {x} < 3 THEN 35 + ({x} - 1) * 8 WHEN {x} < 10 THEN 51 + ({x} - 3) * 2.3e0 WHEN {x} < 25 THEN 67 + ({x} - 10) * 0.8e0 WHEN {x} < 50 THEN 79 + ({x} - 25) * 0.4e0 WHEN {x} < 100 THEN 89 + ({x} - 50) * 0.14e0 ELSE 97 END"


_PX = "coalesce(nullif(final_price, 0), nullif(price_high, 0))"
_IN = "country = 'India'"
_HOST = "regexp_extract(lower(filing_url), '^https?://([^/?#]*)', 1)"
_PRIMARY = "coalesce(" + " OR ".join(f"{_HOST} = '{h}' OR ends_with({_HOST}, '.{h}')" for h in ("sec.gov", "nseindia.com", "sebi.gov.in")) + ", false)"
_STALE = "CASE WHEN status IN ('Filed', 'Upcoming', 'Open', 'Closed', 'Priced') AND age_days > 7 THEN least(0.12e0, 0.12e0 * (age_days - 7) / 53) ELSE 0 END"
_KNOWN = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in ("price_high", "revenue_m", "revenue_prev_m", "net_income_m", "cfo_m", "debt_m", "cash_m", "post_issue_shares_m", "nullif(filing_url, '')", f"(CASE WHEN {_IN} THEN fresh_issue_pct ELSE lockup_days END)"))
_MARGIN = lambda c: f"{c} / nullif(revenue_m, 0) * 100"
_NET_DEBT = "(coalesce(debt_m, 0) - coalesce(cash_m, 0))"
_LEVERAGE = f"CASE WHEN (debt_m IS NOT NULL OR cash_m IS NOT NULL) AND ebitda_m > 0 THEN {_NET_DEBT} / ebitda_m END"
_VOTES = "CASE WHEN dual_class IS NULL THEN 50.0 WHEN dual_class THEN 35.0 ELSE 70.0 END"

SCORED_SQL = f"""{ISSUES_SQL},
    v1 AS (SELECT *, {_PX} AS px, {_PX} * nullif(post_issue_shares_m, 0) AS cap FROM issues),
    v2 AS (SELECT *, CASE WHEN net_income_m > 0 THEN cap / net_income_m END AS pe, CASE WHEN revenue_m > 0 THEN cap / revenue_m END AS ps FROM v1),
    v3 AS (SELECT *, nullif(pe, 0) / nullif(peer_median_pe, 0) AS rpe, nullif(ps, 0) / nullif(peer_median_ps, 0) AS rps FROM v2),
    v4 AS (SELECT *, {_avg(_clamp("100 - (rpe - 0.65e0) * 100", "0", "100"), _clamp("100 - (rps - 0.65e0) * 100", "0", "100"))} AS p_valuation, CASE WHEN rpe IS NOT NULL OR rps IS NOT NULL THEN {_avg("px / rpe", "px / rps")} END AS fair FROM v3),
    p AS (SELECT *, CASE WHEN rpe IS NULL AND rps IS NULL THEN 'INSUFFICIENT DATA' WHEN p_valuation >= 72 THEN 'UNDERPRICED' WHEN p_valuation >= 45 THEN 'FAIR' ELSE 'OVERPRICED' END AS valuation_label,
        50.0 AS p_business,
        {_lin(_avg("(revenue_m / nullif(revenue_prev_m, 0) - 1) * 100", "(revenue_prev_m / nullif(revenue_2y_ago_m, 0) - 1) * 100"), -10, 35)} AS p_growth,
        {_avg(_lin(_MARGIN("ebitda_m"), 0, 25), _lin(_MARGIN("net_income_m"), -5, 15), _lin(_MARGIN("cfo_m"), -5, 18), _lin("CASE WHEN net_income_m > 0 THEN cfo_m / net_income_m END", 0, 1.2), f"coalesce(100 - CASE WHEN ({_LEVERAGE}) IS NOT NULL THEN {_lin(_LEVERAGE, 0, 4)} END, 55.0)")} AS p_financial,
        {_avg(_lin("fresh_issue_pct", 0, 80), "100 - " + _lin("ofs_pct", 0, 100))} AS p_issue,
        CASE WHEN {_IN} THEN 0.38e0 * ({_sub("qib_sub")}) + 0.17e0 * ({_sub("nii_sub")}) + 0.13e0 * ({_sub("retail_sub")}) + 0.17e0 * ({_sub("total_sub")}) + 0.15e0 * {_five("anchor_quality")} ELSE {_avg(_five("underwriter_quality"), _lin("shares_offered_m", 30, 2))} END AS p_demand,
        CASE WHEN {_IN} THEN {_avg(_lin("promoter_retention_pct", 35, 75), _VOTES)} ELSE {_VOTES} END AS p_governance,
        CASE WHEN {_IN} THEN {_lin("gmp_pct", -10, 40)} ELSE 50.0 END AS p_gmp,
        {_avg(_five("market_regime"), _five("sector_regime"))} AS p_market,
        least(greatest((0.68e0 * ({_KNOWN}) / 10 + 0.32e0 * (CASE WHEN {_PRIMARY} THEN 1.0 ELSE 0.72e0 END) - least(0.28e0, n_data_flags * 0.035e0) - least(0.25e0, conflicts * 0.08e0) - ({_STALE})) * 100, 0), 100) AS p_confidence FROM v4),
    t AS (SELECT *, 0.12e0 * p_business + 0.12e0 * p_growth + 0.16e0 * p_financial + 0.18e0 * p_valuation + 0.09e0 * p_issue + 0.09e0 * p_governance + 0.10e0 * p_demand + 0.07e0 * p_market + 0.07e0 * p_confidence AS overall,
        CASE WHEN {_IN} THEN 0.34e0 * p_demand + 0.16e0 * p_valuation + 0.14e0 * p_gmp + 0.14e0 * p_market + 0.07e0 * p_growth + 0.05e0 * p_financial + 0.10e0 * p_confidence ELSE 0.27e0 * p_valuation + 0.18e0 * p_demand + 0.18e0 * p_market + 0.12e0 * p_growth + 0.10e0 * p_financial + 0.15e0 * p_confidence END AS listing,
        0.17e0 * p_business + 0.18e0 * p_growth + 0.19e0 * p_financial + 0.19e0 * p_valuation + 0.10e0 * p_governance + 0.07e0 * p_issue + 0.04e0 * p_market + 0.06e0 * p_confidence AS long_term FROM p)"""

_NUMBERS = ["overall", "listing", "long_term", "p_confidence", "p_growth", "p_financial", "p_valuation", "p_demand", "p_governance", "p_issue", "p_market"]


@query(f"WITH {SCORED_SQL} SELECT id, country, valuation_label, {', '.join(f'{r4(c)} AS {c}' for c in _NUMBERS)}, {r4('fair * 0.9e0')} AS fair_low, {r4('fair * 1.1e0')} AS fair_high FROM t")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.score(issues(spark, d))
    return s.select("id", "country", "valuation_label", *[steady(F.col(c), 4).alias(c) for c in [*_NUMBERS, "fair_low", "fair_high"]])


_VERDICT = """CASE WHEN {gate} THEN 'INSUFFICIENT RELIABLE DATA: NO RECOMMENDATION' WHEN overall >= 80 AND long_term >= 74 THEN 'INVEST: STRONG' WHEN overall >= 70 THEN 'INVEST SELECTIVELY' WHEN overall >= 60 THEN 'WATCH / SMALL ALLOCATION' ELSE 'AVOID / WAIT' END AS recommendation,
    CASE WHEN {gate} THEN 'WAIT FOR VERIFIED DATA' WHEN listing >= 74 AND long_term < 65 THEN 'LISTING GAINS ONLY' WHEN listing >= 70 AND long_term >= 72 THEN 'BOTH: LISTING + LONG TERM' WHEN long_term >= 74 AND listing < 65 THEN 'LONG TERM: WAIT FOR PRICE DISCOVERY' WHEN long_term >= 68 THEN 'LONG TERM BIAS' WHEN listing >= 68 THEN 'LISTING BIAS' ELSE 'NO CLEAR EDGE' END AS horizon"""


@query(f"WITH {SCORED_SQL} SELECT id, {_VERDICT.format(gate='p_confidence < 70')} FROM t")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(issues(spark, d)).select("id", "recommendation", "horizon")


@query(f"WITH {SCORED_SQL} SELECT id, {_VERDICT.format(gate='false')}, {r4('least(greatest(100 / (1 + exp(-(listing - 64) / 9)), 2), 98)')} AS listing_probability, {r4('least(greatest(100 / (1 + exp(-(long_term - 67) / 10)), 2), 98)')} AS long_term_probability FROM t")
def recommendation_bands(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.verdict(scoring.totals(scoring.pillars(issues(spark, d))), strict=False)
    return s.select("id", "recommendation", "horizon", *[steady(F.col(c), 4).alias(c) for c in ("listing_probability", "long_term_probability")])


def _codes(*items: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in items) + ")"


@query(f"""WITH {SCORED_SQL} SELECT id, {_codes(("strong_growth", "p_growth >= 70"), ("sound_financials", "p_financial >= 70"), ("attractive_valuation", "p_valuation >= 72"), ("strong_demand", "p_demand >= 72"))} AS rationale,
    {_codes(("aggressive_valuation", "p_valuation < 42"), ("weak_financials", "p_financial < 45"), ("thin_data", "p_confidence < 70"), ("sellers_exit", "ofs_pct > 65"), ("dual_class", "dual_class"), ("undersubscribed", "total_sub < 1"))} AS risks,
    {_codes(("peer_set", "valuation_label = 'INSUFFICIENT DATA'"), ("cash_flow", "cfo_m IS NULL"), ("qib_demand", f"{_IN} AND qib_sub IS NULL"), ("confidence", "p_confidence < 70"))} AS changes FROM t""")
def verdict_arguments(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(issues(spark, d)).select("id", *[F.array_join(c, ",").alias(c) for c in ("rationale", "risks", "changes")])


@query(f"""WITH {SCORED_SQL}, l AS (SELECT o_custkey AS id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1)
    SELECT id, o_orderkey, o_totalprice, {r4("overall")} AS overall, {_VERDICT.format(gate='p_confidence < 70')} FROM t JOIN l USING (id)""")
def latest_scored(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: each issue's score with its latest snapshot."""
    last = ranked.latest_values(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"]).withColumnRenamed("o_custkey", "id")
    return scoring.score(issues(spark, d)).join(last, "id").select("id", "o_orderkey", "o_totalprice", steady(F.col("overall"), 4).alias("overall"), "recommendation", "horizon")


@query(f"""WITH {ISSUES_SQL}, m AS (SELECT *, concat_ws(', ', CASE WHEN revenue_m IS NULL THEN 'revenue' END, CASE WHEN revenue_prev_m IS NULL THEN 'prior-year revenue' END, CASE WHEN net_income_m IS NULL THEN 'net income' END, CASE WHEN cfo_m IS NULL THEN 'operating cash flow' END, CASE WHEN debt_m IS NULL THEN 'debt' END, CASE WHEN cash_m IS NULL THEN 'cash' END) AS gone FROM issues)
    SELECT id, concat_ws('; ', CASE WHEN coalesce(filing_url, '') = '' THEN 'no filing' WHEN NOT {_PRIMARY} THEN 'secondary source' END, CASE WHEN price_high IS NULL THEN 'no price' END,
      CASE WHEN gone = '' THEN NULL WHEN len(string_split(gone, ', ')) >= 4 THEN 'statements incomplete: ' || gone ELSE 'missing: ' || gone END,
      CASE WHEN post_issue_shares_m IS NULL THEN 'no share count' WHEN coalesce(nullif(peer_median_pe, 0), nullif(peer_median_ps, 0)) IS NULL THEN 'no peers' END,
      CASE WHEN {_IN} AND fresh_issue_pct IS NULL THEN 'no issue split' END, CASE WHEN NOT {_IN} AND lockup_days IS NULL THEN 'no lock-up terms' END, CASE WHEN market_regime IS NULL THEN 'no market regime' END,
      CASE WHEN ({_STALE}) > 0 THEN 'stale record' END, CASE WHEN conflicts > 0 THEN conflicts || ' conflicting fields' END, CASE WHEN n_data_flags > 0 THEN 'flag a' END, CASE WHEN n_data_flags > 1 THEN 'flag b' END) AS reasons FROM m""")
def confidence_reasons(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confidence_reasons(issues(spark, d)).select("id", F.array_join("confidence_reasons", "; ").alias("reasons"))


_FLAGS = [
    ("CRITICAL", "inverted_band", "price_low > price_high"),
    ("HIGH", "neg_cfo", "cfo_m < 0"), ("HIGH", "revenue_decline", "revenue_m / nullif(revenue_prev_m, 0) < 1"), ("HIGH", "high_ofs", "ofs_pct >= 70"), ("HIGH", "undersubscribed", "total_sub < 1"),
    ("WATCH", "pat_cfo_gap", "net_income_m > 0 AND cfo_m < 0.5e0 * net_income_m"), ("WATCH", "losses", "net_income_m < 0"), ("WATCH", "high_leverage", f"({_LEVERAGE}) > 3.5e0"), ("WATCH", "neg_ebitda", "ebitda_m < 0"),
    ("WATCH", "moderate_ofs", "ofs_pct >= 45 AND ofs_pct < 70"), ("WATCH", "low_primary_capital", "fresh_issue_pct < 15 AND ofs_pct > 0"), ("WATCH", "overhang", "market_overhang_pct >= 40"), ("WATCH", "dual_class", "dual_class"),
    ("WATCH", "low_promoter_retention", f"{_IN} AND promoter_retention_pct < 40"), ("WATCH", "weak_qib", f"{_IN} AND qib_sub < 1"), ("INFO", "short_lockup", "lockup_days < 90"),
]
_COUNT = lambda s: " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for sev, _, c in _FLAGS if sev == s)


@query(f"""WITH {ISSUES_SQL}, f AS (SELECT id, {_codes(*[(n, c) for _, n, c in _FLAGS])} AS codes, {", ".join(f"CAST({_COUNT(s)} AS INT) AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "WATCH", "INFO"))} FROM issues)
    SELECT *, CASE WHEN n_critical > 0 THEN 'CRITICAL' WHEN n_high > 0 THEN 'HIGH' WHEN n_watch > 0 THEN 'WATCH' WHEN n_info > 0 THEN 'INFO' END AS worst FROM f""")
def red_flags(spark: SparkSession, d: str) -> DataFrame:
    f = rules.flag_summary(issues(spark, d).withColumn("flags", rules.red_flags()))
    return f.select("id", F.array_join(F.transform("flags", lambda x: x["code"]), ",").alias("codes"), "n_critical", "n_high", "n_watch", "n_info", "worst")


@query(f"""WITH {ISSUES_SQL}, c AS (SELECT *, least(price_low, price_high) AS lo, greatest(price_low, price_high) AS hi, list_filter([qib_sub, nii_sub, retail_sub], lambda x: x IS NOT NULL) AS k FROM issues)
    SELECT id, concat_ws(',', CASE WHEN net_income_m > 0 AND cfo_m < 0 THEN 'profit_vs_cash' END,
      CASE WHEN price_low IS NOT NULL AND price_high IS NOT NULL AND hi > lo AND (final_price < lo - 0.02e0 * (hi - lo) OR final_price > hi + 0.02e0 * (hi - lo)) THEN 'price_outside_band' END,
      CASE WHEN len(k) >= 2 AND (total_sub < list_min(k) - 0.5e0 OR total_sub > list_max(k) + 0.5e0) THEN 'subscription_mismatch' END,
      CASE WHEN fresh_issue_pct + ofs_pct < 90 OR fresh_issue_pct + ofs_pct > 110 THEN 'structure_mismatch' END) AS codes FROM c""")
def contradictions_cross_field(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("id", F.array_join(rules.contradictions(), ",").alias("codes"))


def _ev(growth: str, margin: str, end: str, wacc: str, term: str) -> str:
    flow = lambda y: f"(revenue_m * power(1 + {growth}, {y}) * (({margin} + ({end} - {margin}) * ({y} / 5e0)) * 0.82e0 * 0.75e0 - 0.06e0))"
    return " + ".join(f"{flow(y)} / power(1 + {wacc}, {y})" for y in range(1, 6)) + f" + {flow(5)} * (1 + {term}) / ({wacc} - {term}) / power(1 + {wacc}, 5)"


_DCF_BASE = f"""{ISSUES_SQL}, m AS (SELECT *, {_PX} AS px, {_clamp("ebitda_m / nullif(revenue_m, 0)", "-0.5e0", "0.6e0")} AS m0, CASE WHEN nullif(revenue_m, 0) IS NOT NULL THEN {_clamp("revenue_m / nullif(revenue_prev_m, 0) - 1", "-0.5e0", "2.0e0")} END AS g0, coalesce(cash_m, 0) - coalesce(debt_m, 0) AS net, CASE WHEN {_IN} THEN 0.04e0 ELSE 0.03e0 END AS term FROM issues)"""
_ENDS = {"bear": "greatest(m0, m0 * 0.85e0)", "base": "greatest(m0 + 0.03e0, m0)", "bull": "m0 + 0.08e0"}
_DCF = {n: f"CASE WHEN revenue_m > 0 AND m0 IS NOT NULL THEN {_ev(f'greatest(coalesce(g0, 0.15e0) * {g}e0, -0.1e0)', 'm0', f'least(greatest({_ENDS[n]}, -0.3e0), 0.45e0)', f'{w}e0', 'term')} END" for n, (g, w) in valuation.SCENARIOS.items()}


@query(f"""WITH {_DCF_BASE}, e AS (SELECT *, {", ".join(f"{sql} AS {n}_ev" for n, sql in _DCF.items())} FROM m)
    SELECT id, {", ".join(f"{r4(f'{n}_ev')} AS {n}_ev, {r4(f'(({n}_ev + net) / nullif(post_issue_shares_m, 0))')} AS {n}_fair" for n in _DCF)} FROM e""")
def scenario_dcf(spark: SparkSession, d: str) -> DataFrame:
    s = valuation.scenarios(issues(spark, d))
    return s.select("id", *[steady(F.col(f"{n}_{k}"), 4).alias(f"{n}_{k}") for n in valuation.SCENARIOS for k in ("ev", "fair")])


_HALVED = f"""WITH RECURSIVE {_DCF_BASE}, r AS (SELECT *, px * post_issue_shares_m - net AS goal, least(0.40e0, greatest(coalesce(nullif(m0, 0), 0.10e0), coalesce(nullif(m0, 0), 0.10e0) + 0.05e0)) AS m1, CASE WHEN {_IN} THEN 0.13e0 ELSE 0.11e0 END AS wacc FROM m WHERE revenue_m > 0 AND px * post_issue_shares_m IS NOT NULL),
    s AS (SELECT *, coalesce(nullif(m0, 0), m1) AS ms FROM r),
    b AS (SELECT id, revenue_m, goal, ms, m1, wacc, term, -0.3e0 AS lo, 3.0e0 AS hi, 0 AS step FROM s
      UNION ALL SELECT id, revenue_m, goal, ms, m1, wacc, term, CASE WHEN {_ev('((lo + hi) / 2)', 'ms', 'm1', 'wacc', 'term')} < goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_ev('((lo + hi) / 2)', 'ms', 'm1', 'wacc', 'term')} < goal THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM b WHERE step < 60)"""


@query(f"""{_HALVED}
    SELECT i.id, {r4("(lo + hi) / 2")} AS implied_cagr FROM issues i LEFT JOIN b ON b.id = i.id AND step = 60""")
def reverse_dcf_bisection(spark: SparkSession, d: str) -> DataFrame:
    return valuation.implied_growth(issues(spark, d)).select("id", steady(F.col("implied_cagr"), 4).alias("implied_cagr"))


@query(f"""{_HALVED}, x AS (SELECT m.id, (lo + hi) / 2 AS i, g0, m0, least(0.40e0, greatest(coalesce(nullif(m0, 0), 0.10e0), coalesce(nullif(m0, 0), 0.10e0) + 0.05e0)) AS e FROM m LEFT JOIN b ON b.id = m.id AND step = 60),
    y AS (SELECT *, CASE WHEN i > 0.35 THEN 2 WHEN i > 0.22 THEN 1 ELSE 0 END + CASE WHEN i > g0 * 1.5e0 THEN 2 WHEN i > g0 * 1.15e0 THEN 1 ELSE 0 END + CASE WHEN e > coalesce(m0, 0) + 0.10e0 THEN 1 ELSE 0 END AS gap FROM x)
    SELECT CASE WHEN i IS NULL THEN 'INSUFFICIENT DATA' WHEN gap >= 4 THEN 'EXTREME' WHEN gap >= 3 THEN 'HIGH' WHEN gap >= 1 THEN 'MODERATE' ELSE 'LOW' END AS expectations_gap, count(*) AS n FROM y GROUP BY 1""")
def expectations_gap(spark: SparkSession, d: str) -> DataFrame:
    return valuation.implied_growth(issues(spark, d)).groupBy("expectations_gap").agg(F.count("*").alias("n"))


@query()
def sensitivity_threshold(spark: SparkSession, d: str) -> DataFrame:
    """For all issues, the value of each input at which the recommendation flips; the tests hold it against halvings one by
    one."""

    def rank(df: DataFrame) -> DataFrame:
        return scoring.verdict(scoring.totals(scoring.pillars(df)), strict=False).withColumn("rank", sensitivity.band_rank(F.col("recommendation")))

    return sensitivity.thresholds(issues(spark, d), "id", rank)


_GRADE = f"""CASE WHEN status IN ('Not IPO', 'Withdrawn') THEN 'INVALID_FORWARD_RECORD' WHEN has_return THEN 'GRADED' WHEN status <> 'Listed' THEN 'NOT_YET_ELIGIBLE' WHEN listed_on IS NULL THEN 'BLOCKED_IDENTITY'
    WHEN DATE '2001-08-02' - listed_on < 1 THEN 'NOT_YET_ELIGIBLE' WHEN symbol = '' THEN 'BLOCKED_IDENTITY' WHEN coalesce(final_price, 0) <= 0 THEN 'BLOCKED_OFFER_PRICE' WHEN o_orderpriority = '5-LOW' THEN 'BLOCKED_MARKET_DATA' ELSE 'PENDING' END"""


@query(f"""WITH {ISSUES_SQL}, j AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 4 = 0 AS has_return, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END AS listed_on, status, symbol, final_price, country FROM orders JOIN issues ON o_custkey = id),
    g AS (SELECT country, {_GRADE} AS category FROM j), w AS (SELECT unnest({list(rules.GRADES)}) AS category)
    SELECT category, country, count(*) AS n FROM g GROUP BY 1, 2""")
def grading_ledger(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    j = o.join(issues(spark, d), o["o_custkey"] == F.col("id"))
    category = rules.grade(F.col("status"), F.when(F.col("o_orderkey") % 9 > 0, F.col("day")), F.to_date(F.lit("2001-08-02")), F.col("symbol"), F.col("final_price"), F.when(F.col("o_orderpriority") == "5-LOW", "BLOCKED_MARKET_DATA"), F.col("o_orderkey") % 4 == 0)
    return j.select("country", category.alias("category")).groupBy("category", "country").agg(F.count("*").alias("n"))


@query(f"""WITH {ISSUES_SQL}, x AS (SELECT id, country, board, final_price, CASE WHEN id % 3 = 0 THEN NULL ELSE 10 + CAST((id * 19) % 900 AS DOUBLE) END AS o, CASE WHEN id % 2 = 0 THEN 20 + CAST((id * 13) % 700 AS DOUBLE) END AS off, CASE WHEN id % 4 < 2 THEN 10 + CAST((id * 19) % 900 AS DOUBLE) * 1.01e0 END AS imp, CASE WHEN board = 'SME' THEN 5.5e0 ELSE 3.0e0 END AS hi FROM issues),
    y AS (SELECT *, o / nullif(final_price, 0) AS r, o / nullif(off, 0) AS ro FROM x)
    SELECT id, CASE WHEN r IS NULL OR country <> 'India' THEN 'ok' WHEN coalesce(off > 0 AND abs(off / final_price - 1) > 0.01e0 AND ro BETWEEN 0.5e0 AND hi AND abs(ln(ro)) < abs(ln(r)), false) THEN 'corrected' WHEN r BETWEEN 0.5e0 AND hi OR coalesce(abs(imp / final_price - 1) <= 0.05e0, false) THEN 'ok' WHEN coalesce(abs(imp / o - 1) <= 0.05e0 AND o / imp BETWEEN 0.5e0 AND hi, false) THEN 'corrected' ELSE 'suspect' END AS verdict FROM y""")
def offer_price_plausibility(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).withColumns({"o": F.when(F.col("id") % 3 > 0, 10 + ((F.col("id") * 19) % 900).cast("double")), "off": F.when(F.col("id") % 2 == 0, 20 + ((F.col("id") * 13) % 700).cast("double")), "imp": F.when(F.col("id") % 4 < 2, 10 + ((F.col("id") * 19) % 900).cast("double") * 1.01)})
    v = rules.offer_check(F.col("country"), F.col("board"), F.col("final_price"), F.col("o"), F.col("off"), F.col("imp"))
    return i.select("id", v["verdict"].alias("verdict"))


# ---- snapshots: orders of a customer --------------------------------------------------------------------------------
_SNAP = "snap AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice / 5000 AS overall, o_orderpriority AS recommendation, o_orderstatus AS valuation_label FROM orders)"


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_totalprice") / 5000).alias("overall"), F.col("o_orderpriority").alias("recommendation"), F.col("o_orderstatus").alias("valuation_label"))


_PREV = "SELECT *, lag(overall) OVER w AS po, lag(recommendation) OVER w AS pr, lag(valuation_label) OVER w AS pv, row_number() OVER w AS nth FROM snap WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"WITH {_SNAP}, p AS ({_PREV}) SELECT o_custkey, o_orderkey, {r4('overall - po')} AS delta, pr AS prev_recommendation, nth FROM p")
def prev_snapshot_lag_delta(spark: SparkSession, d: str) -> DataFrame:
    s = ranked.with_previous(snapshots(spark, d), ["o_custkey"], "o_orderdate", "o_orderkey", ["overall", "recommendation"])
    return s.select("o_custkey", "o_orderkey", steady(F.col("overall") - F.col("prev_overall"), 4).alias("delta"), "prev_recommendation", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_SNAP}, p AS ({_PREV}) SELECT o_orderkey, CASE WHEN recommendation = '5-LOW' THEN NULL WHEN nth = 1 THEN CASE WHEN overall >= 60 THEN 'score' END WHEN recommendation <> pr THEN 'recommendation' WHEN valuation_label <> pv THEN 'valuation' WHEN abs(overall - po) >= 5 THEN 'score' END AS kind FROM p""")
def material_change_kind(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d).withColumns({"listing": F.col("overall"), "long_term": F.col("overall"), "confidence": F.lit(100.0)}).withColumn("recommendation", F.when(F.col("recommendation") == "5-LOW", "NO RECOMMENDATION").otherwise(F.col("recommendation")))
    p = ranked.with_previous(s, ["o_custkey"], "o_orderdate", "o_orderkey", ["overall", "listing", "long_term", "recommendation", "valuation_label"])
    # a change from or to no recommendation counts as a change of label
    return timeline.material(p).select("o_orderkey", "kind")


@query(f"""WITH {_SNAP}, p AS ({_PREV}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM p) WHERE back = 1)
    SELECT o_custkey, overall - po AS delta FROM l WHERE abs(overall - po) >= 5 ORDER BY abs(overall - po) DESC, o_custkey LIMIT 6""")
def weekly_biggest_movers(spark: SparkSession, d: str) -> DataFrame:
    return timeline.movers(snapshots(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "overall")


@query(f"""WITH {_SNAP}, p AS ({_PREV}) SELECT o_orderkey, CASE WHEN nth = 1 THEN 'ipo_discovered' WHEN valuation_label IS DISTINCT FROM pv AND valuation_label = 'F' THEN 'status_changed' WHEN valuation_label IS DISTINCT FROM pv THEN 'status_changed' WHEN recommendation <> pr THEN 'recommendation_changed' WHEN abs(overall - po) >= 0.1e0 THEN 'material_score_change' END AS event FROM p""")
def event_stage_rules(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d).withColumn("status", F.when(F.col("valuation_label") == "F", "Listed").otherwise(F.col("valuation_label")))
    still = {c: F.lit(None).cast(t) for c, t in (("final_price", "double"), ("filing_url", "string"), ("price_low", "double"), ("price_high", "double"), ("anchor_quality", "double"), ("total_sub", "double"))}
    p = ranked.with_previous(s.withColumns(still), ["o_custkey"], "o_orderdate", "o_orderkey", ["status", *still, "overall", "recommendation"])
    return timeline.event_stage(p).select("o_orderkey", "event")


@query()
def score_timeline(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d).withColumns({"pillars": F.create_map(F.lit("overall"), F.col("overall"), F.lit("half"), F.col("overall") / 2), "features": F.create_map(F.lit("price"), F.col("overall").cast("string"), F.lit("label"), F.col("valuation_label")), "version": F.substring("recommendation", 1, 1)})
    t = timeline.timeline(s, "o_custkey", "o_orderdate", "o_orderkey")
    return t.select("o_custkey", "o_orderkey", "delta", F.to_json("drivers").alias("drivers"), F.array_join("changed", ",").alias("changed"), "version_change", "recommendation_change")


@query(f"""WITH {ISSUES_SQL}, b AS (SELECT unnest(['0-40', '40-50', '50-60', '60-70', '70-80', '80-100']) AS band), v AS (SELECT CASE WHEN s < 40 THEN '0-40' WHEN s < 50 THEN '40-50' WHEN s < 60 THEN '50-60' WHEN s < 70 THEN '60-70' WHEN s < 80 THEN '70-80' WHEN s < 101 THEN '80-100' END AS band, v FROM (SELECT qib_sub AS s, gmp_pct AS v FROM issues WHERE gmp_pct IS NOT NULL))
    SELECT b.band, count(v.v) AS n, {", ".join(f"{r4(f'avg(CASE WHEN v.v {c} THEN 1.0 WHEN v.v IS NOT NULL THEN 0.0 END) * 100')} AS {n}" for n, c in (("positive", "> 0"), ("above_10", "> 10"), ("above_20", "> 20"), ("loss", "< 0")))}, {r4("avg(v.v)")} AS mean, median(v.v) AS median FROM b LEFT JOIN v USING (band) GROUP BY 1""")
def band_breakdown(spark: SparkSession, d: str) -> DataFrame:
    b = summaries.bands(issues(spark, d), "qib_sub", "gmp_pct")
    return b.withColumns({c: steady(F.col(c), 4) for c in ("positive", "above_10", "above_20", "loss", "mean")})


@query(f"SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, {r4('avg(CAST(o_totalprice AS DOUBLE))')} AS mean FROM orders GROUP BY 1")
def by_year_returns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), steady(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT o_orderkey, isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week FROM orders")
def iso_week_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.week_key(F.col("o_orderdate").cast("date")).alias("week"))


@query("SELECT event_id, CAST(least(3600, power(2, event_id % 12) * 30) AS BIGINT) AS seconds FROM events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.back_off(F.col("event_id") % 12).alias("seconds"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 AS INT) AS d1 FROM orders)
    SELECT o_orderkey, 'day_' || CASE WHEN d1 <= d0 THEN 1 ELSE least(5, 1 + (SELECT count(*) FROM generate_series(1, 12) g(i) WHERE i <= o_orderkey % 12 AND isodow(d0 + CAST(i AS INT)) < 6)) END AS stage FROM o""")
def business_day_stage(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", dates.open_day(day, F.date_add(day, (F.col("o_orderkey") % 12).cast("int"))).alias("stage"))
