"""Statement figures from company facts: totals, parts, mixed years, taxonomies, restatements."""

import pytest

from tidemark.operators import filings

SCHEMA = "id long, taxonomy string, concept string, unit string, val double, start string, end string, filed string, form string, accn string"


def fact(concept, val, end, filed="2024-08-01", start=None, id=1, taxonomy="us-gaap", unit="USD", accn="a1", form="10-K"):
    return (id, taxonomy, concept, unit, None if val is None else float(val), start, end, filed, form, accn)


def year(concept, val, y, **kw):
    return fact(concept, val, f"{y}-12-31", start=f"{y}-01-01", **kw)


@pytest.fixture
def read(spark):
    def run(rows, listed="2024-03-15"):
        listings = spark.createDataFrame([(1, listed), (2, None), (3, "2024-03-15")], "id long, listed string")
        return {(r.id, r.field): r for r in filings.statement(spark.createDataFrame(rows, SCHEMA), "id", listings, "listed").collect()}

    return run


def test_three_years_of_revenue_newest_first_and_what_each_rests_on(read):
    got = read([year("Revenues", 1e6 * (y - 2000), y) for y in (2020, 2021, 2022, 2023)])
    assert [got[1, f].value for f in ("revenue_m", "revenue_prev_m", "revenue_2y_ago_m")] == [23, 22, 21]
    r = got[1, "revenue_m"]
    assert (r.period_start, r.period_end, r.available_at, r.filed, r.rule, r.confidence, r.concept, r.source_form, r.accn, r.unit) == ("2023-01-01", "2023-12-31", "2024-08-01", "2024-08-01", "xbrl_post_ipo_comparative", 0.85, "Revenues", "10-K", "a1", "USD_m")


def test_debt_is_a_total_or_else_the_parts_of_one_day(read):
    total, parts = fact("LongTermDebt", 9e6, "2022-12-31"), [fact("LongTermDebtCurrent", 1e6, "2023-12-31"), fact("LongTermDebtNoncurrent", 4e6, "2023-12-31")]
    assert read([total, *parts])[1, "debt_m"].value == 9  # an older total goes before newer parts
    got = read(parts)[1, "debt_m"]
    assert got.value == 5 and got.concept == "LongTermDebtCurrent+LongTermDebtNoncurrent"
    assert (1, "debt_m") not in read([parts[0], fact("LongTermDebtNoncurrent", 4e6, "2022-12-31")])


def test_ebitda_needs_both_lines_of_one_year(read):
    rows = [year("OperatingIncomeLoss", 10e6, 2023), year("OperatingIncomeLoss", 8e6, 2022), year("DepreciationAndAmortization", 2e6, 2022)]
    got = read(rows)[1, "ebitda_m"]
    assert (got.value, got.period_end, got.concept) == (10, "2022-12-31", "OperatingIncomeLoss+DepreciationAndAmortization")
    assert (1, "ebitda_m") not in read(rows[:1] + [year("DepreciationAndAmortization", 2e6, 2021)])


def test_balances_at_a_year_end_go_before_newer_ones(read):
    cash = [fact("CashAndCashEquivalents", 7e6, "2023-12-31"), fact("CashAndCashEquivalents", 3e6, "2024-02-28")]
    assert read([*cash, year("ProfitLoss", 1e6, 2023)])[1, "cash_m"].value == 7
    assert read(cash)[1, "cash_m"].value == 3
    assert read([fact("CashAndCashEquivalents", 7e6, "2023-12-31", start="2023-12-31")]) == {}  # a period is no day


def test_what_was_filed_first_counts_then_the_better_concept(read):
    rows = [year("Revenues", 5e6, 2023, filed="2024-09-01"), year("Revenues", 6e6, 2023, filed="2024-05-01", accn="b"), year("SalesRevenueNet", 7e6, 2023, filed="2024-05-01", accn="a")]
    assert read(rows)[1, "revenue_m"].value == 7
    assert read(rows[:1] + [year("SalesRevenueNet", 7e6, 2023, filed="2024-09-01")])[1, "revenue_m"].value == 5


def test_the_first_taxonomy_that_has_a_line_gives_it_admissible_or_not(read):
    other = year("Revenue", 3e6, 2023, taxonomy="ifrs-full")
    assert read([other])[1, "revenue_m"].value == 3
    assert (1, "revenue_m") not in read([other, year("Revenues", 4e6, 2019, filed="2019-01-01")])
    assert read([other, year("NetIncomeLoss", 4e6, 2023)])[1, "revenue_m"].value == 3


def test_facts_that_do_not_count(read):
    rows = [year("Revenues", 1e6, 2024), year("Revenues", 1e6, 2023, filed="2025-10-01"), year("Revenues", 1e6, 2022, filed="2024-02-01"), year("Revenues", None, 2021), year("Revenues", 1e6, 2020, unit="EUR"), fact("Revenues", 1e6, "2019-12-31", start="2019-07-01"), fact("Revenues", 1e6, "", start="2023-01-01"), year("Revenues", 1e6, 2023, id=2), year("Revenues", 1e6, 2023, id=9), year("Revenues", 1e6, 2018, filed="soon")]
    assert read(rows) == {}


def test_facts_filed_in_the_month_of_listing_and_the_last_month_count(read):
    assert read([year("Revenues", 1e6, 2023, filed="2024-03-01")]) and read([year("Revenues", 1e6, 2023, filed="2025-09-30")])


def test_shares_come_from_the_first_cover(read):
    rows = [fact("EntityCommonStockSharesOutstanding", n, e, filed=f, taxonomy="dei", unit="shares") for n, e, f in ((5e6, "2024-07-01", "2024-08-01"), (4e6, "2024-06-01", "2024-08-01"), (9e6, "2024-01-01", "2024-02-01"))]
    got = read(rows)[1, "post_issue_shares_m"]
    assert (got.value, got.period_end, got.rule, got.confidence, got.unit, got.period_start) == (4, "2024-06-01", "first_periodic_report", 0.9, "shares_m", "")


def test_repeats_and_no_facts_change_nothing(read):
    rows = [year("Revenues", 1e6, 2023), fact("LongTermDebt", 2e6, "2023-12-31")]
    assert read(rows * 3) == read(rows) and read([]) == {}


def test_comparatives_are_dated_by_their_filing(spark):
    rows = [("xbrl_post_ipo_comparative", "2024-08-01", "2024-03-15"), ("first_periodic_report", "2024-08-01", "2024-03-15"), ("xbrl_post_ipo_comparative", "", "2024-03-15")]
    got = filings.restored(spark.createDataFrame(rows, "rule string, filed string, available_at string")).collect()
    assert [r.available_at for r in got] == ["2024-08-01", "2024-03-15", "2024-03-15"]
