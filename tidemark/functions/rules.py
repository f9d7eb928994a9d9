"""Rules over an issue's fields: red flags, contradictions, what is published, how a prediction is graded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import pick, price_of, ratio, text_or_null, truthy
from tidemark.functions.scoring import is_india

SEVERITIES = ("CRITICAL", "HIGH", "WATCH", "INFO")


def _c(name: str) -> Column:
    return F.col(name)


def _net_debt() -> Column:
    return F.coalesce(_c("debt_m"), F.lit(0.0)) - F.coalesce(_c("cash_m"), F.lit(0.0))


# Fixed rules: code, severity, condition and the figure that it rests on.
RED_FLAGS: tuple[tuple[str, str, Callable[[], Column], Callable[[], Column]], ...] = (
    ("neg_cfo", "HIGH", lambda: _c("cfo_m") < 0, lambda: _c("cfo_m")),
    ("pat_cfo_gap", "WATCH", lambda: (_c("net_income_m") > 0) & (_c("cfo_m") < _c("net_income_m") * 0.5), lambda: _c("cfo_m")),
    ("losses", "WATCH", lambda: _c("net_income_m") < 0, lambda: _c("net_income_m")),
    ("revenue_decline", "HIGH", lambda: ratio(_c("revenue_m"), _c("revenue_prev_m")) < 1, lambda: _c("revenue_m")),
    ("high_leverage", "WATCH", lambda: (_c("debt_m").isNotNull() | _c("cash_m").isNotNull()) & (_c("ebitda_m") > 0) & (ratio(_net_debt(), _c("ebitda_m")) > 3.5), _net_debt),
    ("neg_ebitda", "WATCH", lambda: _c("ebitda_m") < 0, lambda: _c("ebitda_m")),
    ("high_ofs", "HIGH", lambda: _c("ofs_pct") >= 70, lambda: _c("ofs_pct")),
    ("moderate_ofs", "WATCH", lambda: (_c("ofs_pct") >= 45) & (_c("ofs_pct") < 70), lambda: _c("ofs_pct")),
    ("low_primary_capital", "WATCH", lambda: (_c("fresh_issue_pct") < 15) & (_c("ofs_pct") > 0), lambda: _c("fresh_issue_pct")),
    ("overhang", "WATCH", lambda: _c("market_overhang_pct") >= 40, lambda: _c("market_overhang_pct")),
    ("short_lockup", "INFO", lambda: _c("lockup_days") < 90, lambda: _c("lockup_days").cast("double")),
    ("dual_class", "WATCH", lambda: _c("dual_class"), lambda: _c("dual_class").cast("double")),
    ("low_promoter_retention", "WATCH", lambda: is_india(_c("country")) & (_c("promoter_retention_pct") < 40), lambda: _c("promoter_retention_pct")),
    ("undersubscribed", "HIGH", lambda: _c("total_sub") < 1, lambda: _c("total_sub")),
    ("weak_qib", "WATCH", lambda: is_india(_c("country")) & (_c("qib_sub") < 1), lambda: _c("qib_sub")),
    ("inverted_band", "CRITICAL", lambda: _c("price_low") > _c("price_high"), lambda: _c("price_low")),
)


def red_flags() -> Column:
    """array<struct<rank, nth, code, severity, value>>: the rules that hold, most severe first, then in the rules' order."""
    rows = [F.when(hold(), F.struct(F.lit(SEVERITIES.index(s)).alias("rank"), F.lit(i).alias("nth"), F.lit(code).alias("code"), F.lit(s).alias("severity"), value().cast("double").alias("value"))) for i, (code, s, hold, value) in enumerate(RED_FLAGS)]
    return F.sort_array(F.filter(F.array(*rows), lambda x: x.isNotNull()))


def flag_summary(df: DataFrame, flags: str = "flags") -> DataFrame:
    """Counts by severity, the total, and the worst severity."""
    count = lambda s: F.size(F.filter(F.col(flags), lambda x: x["severity"] == s))
    return df.withColumns({f"n_{s.lower()}": count(s) for s in SEVERITIES} | {"n_flags": F.size(flags), "worst": F.try_element_at(F.transform(F.col(flags), lambda x: x["severity"]), F.lit(1))})


def contradictions() -> Column:
    """Codes of figures within one record that don't fit each other."""
    low, high = F.least(_c("price_low"), _c("price_high")), F.greatest(_c("price_low"), _c("price_high"))
    band, final = high - low, _c("final_price")
    both = _c("price_low").isNotNull() & _c("price_high").isNotNull()
    known = F.filter(F.array("qib_sub", "nii_sub", "retail_sub"), lambda x: x.isNotNull())
    total, parts = _c("total_sub"), _c("fresh_issue_pct") + _c("ofs_pct")
    rows = [
        F.when((_c("net_income_m") > 0) & (_c("cfo_m") < 0), "profit_vs_cash"),
        F.when(both & (band > 0) & ((final < low - band * 0.02) | (final > high + band * 0.02)), "price_outside_band"),
        F.when((F.size(known) >= 2) & ((total < F.array_min(known) - 0.5) | (total > F.array_max(known) + 0.5)), "subscription_mismatch"),
        F.when((parts < 90) | (parts > 110), "structure_mismatch"),
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


# Fixed: the categories of a graded prediction.
GRADES = ("GRADED", "PENDING", "BLOCKED_IDENTITY", "BLOCKED_OFFER_PRICE", "BLOCKED_MARKET_DATA", "NOT_YET_ELIGIBLE", "INVALID_FORWARD_RECORD")
GRADABLE = GRADES[:5]


def grade(status: Column, listed_on: Column, today: Column, symbol: Column, final_price: Column, outcome_status: Column, has_return: Column) -> Column:
    """Which category a forward prediction falls in; the first rule that holds decides."""
    return pick(
        (F.coalesce(status, F.lit("")).isin("Not IPO", "Withdrawn"), "INVALID_FORWARD_RECORD"),
        (F.coalesce(has_return, F.lit(False)), "GRADED"),
        (F.coalesce(status, F.lit("")) != "Listed", "NOT_YET_ELIGIBLE"),
        (listed_on.isNull(), "BLOCKED_IDENTITY"),
        (F.datediff(today, listed_on) < 1, "NOT_YET_ELIGIBLE"),
        (text_or_null(symbol).isNull(), "BLOCKED_IDENTITY"),
        (F.coalesce(final_price, F.lit(0.0)) <= 0, "BLOCKED_OFFER_PRICE"),
        (outcome_status == "BLOCKED_MARKET_DATA", "BLOCKED_MARKET_DATA"),
        otherwise="PENDING",
    )


#: Days after which a United States filing is stale, and an Indian issue without a listing is given up.
STALE_FILING_DAYS, UNLISTED_DAYS = 365, 45


def exclusion(country: Column, status: Column, flags: Column, filed_days: Column, closed_days: Column) -> Column:
    """Why an active row isn't published, or null: no initial offering, a stale filing, or closed long ago without a listing."""
    not_ipo = F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.startswith("non_ipo_registration"))
    stale = ~is_india(country) & (status == "Filed") & (filed_days > STALE_FILING_DAYS)
    closed = is_india(country) & (status == "Closed") & (closed_days > UNLISTED_DAYS)
    return pick((not_ipo, "not an initial offering"), (stale, "stale filing"), (closed, "closed without a listing"))


# Fixed: how far along an issue's life each status is.
LIFECYCLE = {"Filed": 10, "Upcoming": 20, "Open": 30, "Closed": 40, "Priced": 50, "Listed": 60, "Withdrawn": 70, "Not IPO": 80}


def lifecycle_rank(status: Column) -> Column:
    """An unknown status ranks 0."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LIFECYCLE.items() for x in kv])[F.coalesce(status, F.lit(""))], F.lit(0))


def may_become(old: Column, new: Column) -> Column:
    """A status never goes back, and nothing becomes no status; from none, anything may come."""
    known, asked = text_or_null(old), text_or_null(new)
    return F.coalesce(asked.isNotNull() & (known.isNull() | (known == asked) | (lifecycle_rank(new) >= lifecycle_rank(old))), F.lit(False))


#: Fixed: what a first open may be of an offer price, by board, and how near an implied price must come.
OPEN_MIN, OPEN_MAX = 0.5, {"SME": 5.5, "Mainboard": 3.0}
NEAR = 0.05


def offer_check(country: Column, board: Column, offer: Column, first_open: Column, official: Column, implied: Column) -> Column:
    """struct(verdict, price): whether an Indian offer price fits the first open; if not, whether an official price or one
    implied by issue size over shares does."""
    most = F.when(board == "SME", OPEN_MAX["SME"]).otherwise(OPEN_MAX["Mainboard"])
    seen, better = ratio(first_open, truthy(offer)), ratio(first_open, truthy(official))
    fits = lambda r: F.coalesce(r.between(OPEN_MIN, most), F.lit(False))
    near = lambda a, b: F.coalesce(F.abs(ratio(a, b) - 1) <= NEAR, F.lit(False))
    by_official = (official > 0) & (F.abs(ratio(official, offer) - 1) > 0.01) & fits(better) & (F.abs(F.ln(better)) < F.abs(F.ln(seen)))
    out = lambda verdict, price: F.struct(F.lit(verdict).alias("verdict"), price.cast("double").alias("price"))
    none = F.lit(None)
    return pick(
        (seen.isNull() | F.coalesce(truthy(first_open).isNull(), F.lit(True)) | ~is_india(country), out("ok", none)),
        (F.coalesce(by_official, F.lit(False)), out("corrected", official)),
        (fits(seen) | near(implied, offer), out("ok", none)),
        (near(implied, first_open) & fits(ratio(first_open, implied)), out("corrected", implied)),
        otherwise=out("suspect", none),
    )


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, flags)


def market_cap(final: Column, high: Column, shares: Column) -> Column:
    return price_of(final, high) * shares
