"""Statement figures from company facts: for each field the first group of lines that all exist for one period.

A line is a list of concepts that mean the same, a field one or more groups of lines: a debt total, or else its current and
noncurrent parts; operating income with the depreciation of that very year. Facts become one row per company and period end
with a column per line (of restated facts what was filed first counts), and these rows one array per company, which is
read newest period first. So whatever the number of fields, facts shuffle once by period and once, added up, by company.
Every value carries the period, filing and rule that it rests on."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: concepts of each line, best first, of either taxonomy; values in dollars.
YEARLY = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "Revenue"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "cfo": ("NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities"),
    "operating_income": ("OperatingIncomeLoss", "ProfitLossFromOperatingActivities"),
    "d_and_a": ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "DepreciationAndAmortisationExpense"),
}
AT_A_DAY = {
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashAndCashEquivalents"),
    "debt": ("LongTermDebt",),
    "debt_current": ("LongTermDebtCurrent",),
    "debt_noncurrent": ("LongTermDebtNoncurrent",),
}
SHARES = "EntityCommonStockSharesOutstanding"
#: Fixed: taxonomies, of which the first that has a line at all gives it; days of a yearly period; months from listing to filing.
TAXONOMIES, YEAR_DAYS, MONTHS = ("us-gaap", "ifrs-full"), (350, 380), 18
#: Fixed: rules of availability and how far each is trusted.
COMPARATIVE, FIRST_REPORT = ("xbrl_post_ipo_comparative", 0.85), ("first_periodic_report", 0.9)


class Figure(NamedTuple):
    """A field: groups of lines, each summed over one period; which of the periods from the newest; whether periods at whose
    end a year closes go first."""

    field: str
    groups: tuple[tuple[str, ...], ...]
    nth: int = 0
    at_year_end: bool = False


FIGURES = (
    Figure("revenue_m", (("revenue",),)),
    Figure("revenue_prev_m", (("revenue",),), 1),
    Figure("revenue_2y_ago_m", (("revenue",),), 2),
    Figure("net_income_m", (("net_income",),)),
    Figure("cfo_m", (("cfo",),)),
    Figure("ebitda_m", (("operating_income", "d_and_a"),)),
    Figure("cash_m", (("cash",),), at_year_end=True),
    Figure("debt_m", (("debt",), ("debt_current", "debt_noncurrent")), at_year_end=True),
)
OBSERVATION = "field string, value double, unit string, period_start string, period_end string, source_form string, filed string, accn string, available_at string, rule string, confidence double, concept string"


def _months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def _line_of(figures: tuple[Figure, ...]) -> tuple[dict[str, tuple[str, ...]], set[str]]:
    used = {line for f in figures for g in f.groups for line in g} | {"revenue", "net_income"}
    return {k: v for k, v in {**YEARLY, **AT_A_DAY}.items() if k in used}, used & set(YEARLY)


def _facts(rows: DataFrame, id_col: str, listings: DataFrame, listed: str) -> DataFrame:
    """Facts with all they need, as dates and with their company's listing."""
    dates = {"_end": F.try_to_date("end"), "_start": F.try_to_date("start"), "_filed": F.try_to_date("filed")}
    whole = rows.filter("val is not null and end is not null and end != '' and filed is not null and filed != ''").withColumns(dates)
    known = listings.select(id_col, F.col(listed).cast("date").alias("_listed")).filter("_listed is not null").distinct()
    since = _months(F.col("_listed"), F.col("_filed"))
    return whole.join(known, id_col).withColumn("_in_time", F.coalesce(since.between(0, MONTHS), F.lit(False)))


def periods(rows: DataFrame, id_col: str, listings: DataFrame, listed: str, figures: tuple[Figure, ...] = FIGURES) -> DataFrame:
    """One row per company: an array of its period ends, newest first, each with a struct per line (null where the line has
    no admissible fact). Admissible: ended by listing, filed in the months after it, and of a year's length if yearly."""
    lines, yearly = _line_of(figures)
    pairs = [(concept, line) for line, concepts in lines.items() for concept in concepts]
    line = F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("concept")]
    rank = F.create_map(*[F.lit(x) for concepts in lines.values() for i, c in enumerate(concepts) for x in (c, i)])[F.col("concept")]
    taxonomy = F.array_position(F.array(*map(F.lit, TAXONOMIES)), F.col("taxonomy"))
    facts = _facts(rows.filter(F.col("concept").isin([c for c, _ in pairs]) & F.col("taxonomy").isin(*TAXONOMIES) & (F.col("unit") == "USD")), id_col, listings, listed)
    long_enough = F.coalesce(F.datediff("_end", "_start").between(*YEAR_DAYS), F.lit(False))
    right_kind = F.when(line.isin(*sorted(yearly)), long_enough).otherwise(F.coalesce(F.col("start"), F.lit("")) == "")
    usable = right_kind & F.col("_in_time") & F.coalesce(F.col("_end") <= F.col("_listed"), F.lit(False))
    fact = F.struct(F.col("val").cast("double").alias("val"), F.coalesce("start", F.lit("")).alias("start"), F.coalesce("form", F.lit("")).alias("form"), F.col("filed"), F.coalesce("accn", F.lit("")).alias("accn"), F.col("concept"))
    first = F.min(F.when(F.col("usable"), F.struct("filed", F.coalesce("accn", F.lit("")).alias("accn"), rank.alias("rank"), fact.alias("fact"))))
    # facts of either taxonomy until it is known whether a company has the line in the first one
    each = facts.withColumns({"line": line, "tax": taxonomy, "usable": usable}).groupBy(id_col, "end", "line", "tax").agg(first.alias("best"))
    cells = [F.first(F.when((F.col("line") == name) & (F.col("tax") == t), F.struct(F.lit(True).alias("there"), F.col("best.fact").alias("fact"))), True).alias(f"{name}_{t}") for name in lines for t in (1, 2)]
    grid = each.groupBy(id_col, "end").agg(*cells)
    names = [f"{name}_{t}" for name in lines for t in (1, 2)]
    rows_of = F.reverse(F.array_sort(F.collect_list(F.struct("end", *names)))).alias("p")
    held = grid.groupBy(id_col).agg(rows_of, *[F.max(F.col(f"{name}_1").isNotNull()).alias(f"has_{name}") for name in lines])
    pick = lambda x: F.struct(x["end"].alias("end"), *[F.when(F.col(f"has_{name}"), x[f"{name}_1"]["fact"]).otherwise(x[f"{name}_2"]["fact"]).alias(name) for name in lines])
    return held.select(id_col, F.transform("p", pick).alias("periods"))


def _with_all(p: Column, group: tuple[str, ...]) -> Column:
    return F.filter(p, lambda x: reduce(lambda a, b: a & b, [x[line].isNotNull() for line in group]))


def _chosen(figure: Figure) -> Column:
    """The observation of a figure from the array of periods, in an array of none or one."""
    p = F.col("periods")
    closed = lambda x: x["revenue"].isNotNull() | x["net_income"].isNotNull()

    def seen(group: tuple[str, ...]) -> Column:
        full = _with_all(p, group)
        if figure.at_year_end:  # those at whose end a year closes first, each part newest first as before
            full = F.concat(F.filter(full, closed), full)
        value = lambda x: reduce(lambda a, b: a + b, [x[line]["val"] for line in group]) / 1e6
        concept = lambda x: F.concat_ws("+", *[x[line]["concept"] for line in group])
        return F.transform(F.slice(full, figure.nth + 1, 1), lambda x: _observation(figure.field, value(x), "USD_m", x["end"], x[group[0]], concept(x), COMPARATIVE))

    first, *others = map(seen, figure.groups)
    return F.slice(F.concat(first, *others), 1, 1)


def _observation(field: str, value: Column, unit: str, end: Column, fact: Column, concept: Column, rule: tuple[str, float]) -> Column:
    """A value with where it comes from. It is available from the day that its filing was, never from the listing's."""
    return F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(unit).alias("unit"), fact["start"].alias("period_start"), end.alias("period_end"), fact["form"].alias("source_form"), fact["filed"].alias("filed"), fact["accn"].alias("accn"), fact["filed"].alias("available_at"), F.lit(rule[0]).alias("rule"), F.lit(rule[1]).alias("confidence"), concept.alias("concept"))


def statement(rows: DataFrame, id_col: str, listings: DataFrame, listed: str, figures: tuple[Figure, ...] = FIGURES) -> DataFrame:
    """(id, field, value in millions, unit, period_start, period_end, source_form, filed, accn, available_at, rule,
    confidence, concept): one row per company and field that its facts give. rows: id, taxonomy, concept, unit, val, start,
    end, filed, form, accn (see sources.readers.facts); listings: id and the day of listing. Companies without a listing, and
    facts without value, end or filing day, give nothing; repeated facts change nothing."""
    found = periods(rows, id_col, listings, listed, figures)
    out = found.select(id_col, F.inline(F.flatten(F.array(*map(_chosen, figures)))))
    fact = F.struct(F.lit("").alias("start"), F.coalesce("form", F.lit("")).alias("form"), F.col("filed"), F.coalesce("accn", F.lit("")).alias("accn"))
    cover = _facts(rows.filter((F.col("concept") == SHARES) & (F.col("taxonomy") == "dei") & (F.col("unit") == "shares")), id_col, listings, listed)
    first = cover.filter("_in_time").groupBy(id_col).agg(F.min(F.struct("filed", "end", F.coalesce("accn", F.lit("")).alias("accn"), F.col("val").cast("double").alias("val"), fact.alias("fact"))).alias("s"))
    shares = first.select(id_col, F.inline(F.array(_observation("post_issue_shares_m", F.col("s.val") / 1e6, "shares_m", F.col("s.end"), F.col("s.fact"), F.lit(SHARES), FIRST_REPORT))))
    return out.unionByName(shares)


def restored(observations: DataFrame) -> DataFrame:
    """Observations by the comparative rule that were dated otherwise, dated by their filing; no others change."""
    wrong = (F.col("rule") == COMPARATIVE[0]) & (F.length("filed") == 10) & (F.col("available_at") != F.col("filed"))
    return observations.withColumn("available_at", F.when(wrong, F.col("filed")).otherwise(F.col("available_at")))
