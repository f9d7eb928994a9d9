import pytest
from pyspark.sql import functions as F

from tidemark.functions import basic, dates, rules, scoring, text, valuation
from tidemark.plans.base import ISSUE

KINDS = {"id": "long", "dual_class": "boolean", "lockup_days": "int", "age_days": "int", "conflicts": "int", "n_data_flags": "int"} | dict.fromkeys(("company", "sector", "country", "board", "status", "symbol", "filing_url"), "string")


@pytest.fixture(scope="module")
def frame(spark):
    def make(*rows):
        cols = [c for c in ISSUE if c != "balance"] + ["data_flags"]
        schema = ", ".join(f"{c} {KINDS.get(c, 'array<string>' if c == 'data_flags' else 'double')}" for c in cols)
        return spark.createDataFrame([tuple(({"id": i, "country": "India", "status": "Open", "age_days": 0, "conflicts": 0} | r).get(c) for c in cols) for i, r in enumerate(rows)], schema)

    return make


STRONG = dict(price_low=90.0, price_high=100.0, final_price=100.0, post_issue_shares_m=10.0, revenue_m=800.0, revenue_prev_m=600.0, revenue_2y_ago_m=450.0, ebitda_m=200.0, net_income_m=110.0, cfo_m=140.0, debt_m=50.0, cash_m=90.0, fresh_issue_pct=80.0, ofs_pct=20.0, promoter_retention_pct=75.0, qib_sub=80.0, nii_sub=60.0, retail_sub=20.0, total_sub=60.0, anchor_quality=5.0, market_regime=4.0, sector_regime=4.0, peer_median_pe=30.0, peer_median_ps=4.0, dual_class=False, filing_url="https://www.sebi.gov.in/x")
WEAK = dict(price_low=100.0, price_high=90.0, final_price=100.0, post_issue_shares_m=10.0, revenue_m=100.0, revenue_prev_m=150.0, ebitda_m=-10.0, net_income_m=-20.0, cfo_m=-25.0, debt_m=100.0, cash_m=1.0, fresh_issue_pct=10.0, ofs_pct=90.0, qib_sub=0.5, total_sub=0.4, dual_class=True, promoter_retention_pct=20.0, filing_url="https://blog.example.com")


def test_strong_beats_weak_and_sparse_is_gated(frame):
    strong, weak, sparse = scoring.score(frame(STRONG, WEAK, {"price_high": 10.0})).orderBy("id").collect()
    assert strong["overall"] > 75 > weak["overall"] and strong["recommendation"].startswith("INVEST")
    assert sparse["recommendation"].startswith("INSUFFICIENT") and sparse["horizon"] == "WAIT FOR VERIFIED DATA"
    assert sparse["p_growth"] == 100.0  # what is unknown is averaged to 50 before the line from -10 to 35
    assert sparse["p_market"] == sparse["p_issue"] == 50.0 and sparse["valuation_label"] == "INSUFFICIENT DATA"
    assert "dual_class" in weak["risks"] and "strong_growth" in strong["rationale"]


def test_a_score_by_hand(frame):
    (r,) = scoring.score(frame({"country": "United States", "underwriter_quality": 4.0, "shares_offered_m": 16.0, "market_regime": 3.0})).collect()
    assert r["p_demand"] == pytest.approx((80 + 50) / 2) and r["p_market"] == 55.0
    conf = (0.32 * 0.72) * 100
    assert r["p_confidence"] == pytest.approx(conf)
    assert r["listing"] == pytest.approx(0.27 * 50 + 0.18 * 65 + 0.18 * 55 + 0.12 * 100 + 0.10 * 51 + 0.15 * conf)


@pytest.mark.parametrize(("x", "want"), [(None, 50), (0.1, 10), (0.5, 17.5), (1, 35), (3, 51), (9.999, 67.0977), (10, 67), (25, 79), (50, 89), (99.999, 95.99986), (100, 97)])
def test_subscription_curve(spark, x, want):
    assert spark.range(1).select(basic.subscription(F.lit(x).cast("double"))).first()[0] == pytest.approx(want)


def test_flags_of_the_weak_issue(frame):
    f = rules.flag_summary(frame(WEAK, STRONG).withColumn("flags", rules.red_flags())).orderBy("id").collect()
    codes = [x["code"] for x in f[0]["flags"]]
    assert codes[0] == "inverted_band" and {"neg_cfo", "losses", "revenue_decline", "high_ofs", "undersubscribed", "weak_qib", "dual_class", "neg_ebitda", "low_primary_capital", "low_promoter_retention"} < set(codes)
    assert f[0]["worst"] == "CRITICAL" and f[1]["worst"] is None and f[1]["n_flags"] == 0


def test_contradictions(frame):
    r = frame({"net_income_m": 5.0, "cfo_m": -1.0, "price_low": 10.0, "price_high": 12.0, "final_price": 13.0, "qib_sub": 2.0, "nii_sub": 3.0, "total_sub": 9.0, "fresh_issue_pct": 50.0, "ofs_pct": 20.0}, {})
    got = r.select(rules.contradictions().alias("c")).collect()
    assert got[0]["c"] == ["profit_vs_cash", "price_outside_band", "subscription_mismatch", "structure_mismatch"] and got[1]["c"] == []


@pytest.mark.parametrize(("url", "want"), [("https://www.sec.gov/a", True), ("https://sec.gov.example.com/", False), ("https://consensus.com/?ref=nse", False), ("https://NSEINDIA.com", True), ("", False), (None, False), ("http://[bad", False)])
def test_primary_sources(spark, url, want):
    assert spark.range(1).select(scoring.primary_source(F.lit(url).cast("string"))).first()[0] is want


@pytest.mark.parametrize(("status", "age", "want"), [("Open", 7, 0), ("Open", 60, 0.12), ("Open", 400, 0.12), ("Listed", 400, 0)])
def test_staleness(spark, status, age, want):
    assert spark.range(1).select(scoring.staleness(F.lit(status), F.lit(age))).first()[0] == pytest.approx(want)


def test_implied_growth_gives_back_its_price(frame):
    (r,) = valuation.implied_growth(frame(STRONG)).collect()
    g, m, end = r["implied_cagr"], 0.25, 0.30
    flows = [800 * (1 + g) ** y * ((m + (end - m) * y / 5) * 0.82 * 0.75 - 0.06) for y in range(1, 6)]
    value = sum(f / 1.13**y for y, f in enumerate(flows, 1)) + flows[-1] * 1.04 / 0.09 / 1.13**5
    assert value == pytest.approx(100 * 10 - 40, rel=1e-6)


def test_scenarios_are_ordered(frame):
    s, none = valuation.scenarios(frame(STRONG, {})).orderBy("id").collect()
    assert s["bear_ev"] < s["base_ev"] < s["bull_ev"] and none["base_ev"] is None and not none["available"]


def test_every_grade_is_reached(spark):
    rows = [("Withdrawn", "2024-01-01", "S", 1.0, None, False), ("Listed", "2024-01-01", "S", 1.0, None, True), ("Open", None, "", None, None, False), ("Listed", None, "S", 1.0, None, False), ("Listed", "2024-06-01", "S", 1.0, None, False), ("Listed", "2024-01-01", "", 1.0, None, False), ("Listed", "2024-01-01", "S", 0.0, None, False), ("Listed", "2024-01-01", "S", 1.0, "BLOCKED_MARKET_DATA", False), ("Listed", "2024-01-01", "S", 1.0, None, None)]
    df = spark.createDataFrame(rows, "status string, d string, symbol string, price double, outcome string, has boolean")
    got = [r[0] for r in df.select(rules.grade(F.col("status"), F.to_date("d"), F.to_date(F.lit("2024-06-01")), F.col("symbol"), F.col("price"), F.col("outcome"), F.col("has"))).collect()]
    assert got == ["INVALID_FORWARD_RECORD", "GRADED", "NOT_YET_ELIGIBLE", "BLOCKED_IDENTITY", "NOT_YET_ELIGIBLE", "BLOCKED_IDENTITY", "BLOCKED_OFFER_PRICE", "BLOCKED_MARKET_DATA", "PENDING"]
    assert set(got) == set(rules.GRADES)


@pytest.mark.parametrize(("old", "new", "want"), [("Listed", "Open", False), ("Open", "Listed", True), (None, "Filed", True), ("Filed", "", False), ("Open", "Open", True), ("odd", "Filed", True)])
def test_status_never_goes_back(spark, old, new, want):
    assert spark.range(1).select(rules.may_become(F.lit(old).cast("string"), F.lit(new).cast("string"))).first()[0] is want


@pytest.mark.parametrize(("raw", "iso"), [("2024-03-05T10:00", "2024-03-05"), ("05-Mar-2024", "2024-03-05"), ("05-MAR-2024", "2024-03-05"), ("05 Mar 2024", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("20240305", "2024-03-05"), ("05-03-2024", "2024-03-05"), ("05-Mar-24", "2024-03-05"), (" 2024-02-30", None), ("soon", None), ("", None), (None, None)])
def test_date_spellings(spark, raw, iso):
    got = spark.range(1).select(dates.parsed(F.lit(raw).cast("string")).cast("string")).first()[0]
    assert got == iso


@pytest.mark.parametrize(("a", "b"), [("Adani Green Energy Ltd.", "ADANI GREEN ENERGY LIMITED"), ("A & B (India) Pvt. Ltd", "a and b"), ("The Company", "the company inc"), ("ＡＢＣ Corp", "abc")])
def test_names_that_are_equal(spark, a, b):
    x, y = spark.range(1).select(text.canonical_name(F.lit(a)), text.canonical_name(F.lit(b))).first()
    assert x == y or (a, b) == ("The Company", "the company inc") and x and y


@pytest.mark.parametrize(("raw", "want"), [("1,234.5", 1234.5), ("(12.5)", -12.5), ("₹ 7", 7.0), ("-", None), ("", None), ("Rs. 10", 10.0), ("-3", -3.0), ("12%", 12.0), ("abc", None)])
def test_numbers(spark, raw, want):
    assert spark.range(1).select(text.number(F.lit(raw))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("SME-IPO", "SME IPO"), ("Main Board IPO", "IPO"), ("invit ipo", "InvIT IPO"), ("Preferential", None), ("", None), (None, None)])
def test_issue_types(spark, raw, want):
    assert spark.range(1).select(text.issue_type(F.lit(raw).cast("string"))).first()[0] == want


def test_thresholds_are_those_of_halvings_one_by_one(spark):
    from tidemark.operators import sensitivity as s

    def ranked(df):
        return df.withColumn("rank", F.when(F.col("x") + F.col("y") > 6.2, 0).when(F.col("x") + F.col("y") > 3.1, 1).when((F.col("x") > 1.27) & (F.col("x") < 1.91), 3).otherwise(2))

    def plain(x, y):
        return 0 if x + y > 6.2 else 1 if x + y > 3.1 else 3 if 1.27 < x < 1.91 else 2

    levers = [
        s.Lever("x", "x", True, lambda: F.col("x"), lambda v: v, lambda v: F.lit(9.0), lambda v, w: w > v + 0.1),
        s.Lever("x", "x", False, lambda: F.col("x"), lambda v: F.lit(0.0), lambda v: v, lambda v, w: w < v),
        s.Lever("y", "y", False, lambda: F.col("y"), lambda v: v, lambda v: v * 3, lambda v, w: F.lit(True), lambda: F.col("x") < 2),
        s.Lever("y", "y", True, lambda: F.col("y"), lambda v: v, lambda v: F.lit(7.0), lambda v, w: F.lit(True)),
    ]
    rows = [(i, 0.37 * i + 0.2, 5.0 - 0.41 * i if i % 4 else None) for i in range(12)] + [(50, 1.0, 0.0)]
    want = set()
    for i, x, y in rows:
        for n, (name, better) in enumerate((("x", True), ("x", False), ("y", False), ("y", True))):
            now = x if name == "x" else y
            if now in (None, 0.0) or (n == 2 and not x < 2):
                continue
            low, high = [(now, 9.0), (0.0, now), (now, now * 3), (now, 7.0)][n]
            at = lambda v: plain(v, y) if name == "x" else plain(x, v)  # noqa: B023, E731
            if y is None:
                continue
            base = plain(x, y)
            flips = lambda v: at(v) < base if better else at(v) > base  # noqa: B023, E731
            if not flips(high):
                continue
            a, b = (low, high) if better else (high, low)
            for _ in range(24):
                mid = (a + b) / 2
                a, b = (a, mid) if flips(mid) else (mid, b)
            if n == 0 and not round(b, 2) > now + 0.1 or n == 1 and not round(b, 2) < now:
                continue
            want.add((i, name, "better" if better else "worse", round(b, 2)))
    df = spark.createDataFrame([r for r in rows if r[2] is not None], "id long, x double, y double")
    got = {(r["id"], r["lever"], r["direction"], r["value"]) for r in s.thresholds(df, "id", ranked, levers).collect()}
    assert got == want and len(want) > 5
