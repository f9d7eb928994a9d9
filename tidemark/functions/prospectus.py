"""What a prospectus says of its offering, by what a cover has to tell: what is sold and by whom, whether it has a market and a
price there already, where it will be listed, and at what price it is offered.

The text is reduced to lower-case words and full stops. A statement is a regular expression that looks for word classes within
one sentence, so that each is one test of the whole text. An amount of money is the price if what stands before it is a noun
for the price, followed by nothing but words that describe the security, or say "is"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import pick
from tidemark.functions.text import decoded

#: Fixed: a price per share lies in this band; anything else is a total or a par value.
PRICE_BAND = (0.5, 500.0)
#: Fixed: how much is read past the first mark of the cover's price table, and of a text without one.
PAST_TABLE, NO_TABLE = 1_500, 30_000
#: Words of the cover's price table.
TABLE_MARKS = ("price to public", "price to the public", "underwriting discounts and commissions", "underwriting discount and commissions", "proceeds before expenses")


#: Word classes: what is sold, who holds it, where it is traded (on a national exchange, or anywhere).
SECURITY = r"(?:stock|shares?|units?|adss?|securities)"
HOLDERS = r"(?:(?:share|stock|security|unit)?holders?|sellers?)"
NATIONAL = r"(?:nasdaq|nyse|new york stock exchange|cboe)"
VENUE = rf"(?:{NATIONAL}|otc\w*|pink|tsxv?|toronto stock exchange|cse|asx|aim)"
SYMBOL = r"symbols?"


def _sentence(*parts: str, none: str | None = None) -> str:
    """A sentence that holds all parts, in any order, and not none."""
    within = lambda p: rf"[^.]*\b(?:{p})\b"
    return r"(?:^|\.)" + "".join(f"(?={within(p)})" for p in parts) + (f"(?!{within(none)})" if none else "")


# what is sold
MERGER = [_sentence(r"proxy statement(?: and)? prospectus"), _sentence("business combination agreement")]
DEBT = [_sentence(r"price (?:to (?:the )?public )?percentage")]
SPIN_OFF = [_sentence("spin off", r"record date|distribut\w+")]
DIRECT = [_sentence("direct listing", r"in connection with (?:our|the)|reference price"), _sentence(r"current reference price"), _sentence("unlike an initial public offering", "resale")]
# who sells it
ISSUER = [_sentence(r"we are (?:\w+ )?offering"), _sentence(r"offered by (?:us|the company|our company)"), _sentence(r"(?:ipo|primary offering|initial public offering) prospectus"), _sentence(r"in (?:our|the) initial public offering")]
RESALE = [_sentence(r"relates? to (?:\w+ ){0,3}re(?:sale|offer)"), _sentence(r"prospectus relates to", r"offer and (?:re)?sale", rf"{HOLDERS}|from time to time")]
# whether it has a market and a price
TRADED = [
    _sentence(r"last reported (?:\w+ ){0,2}price"),
    _sentence(r"closing (?:\w+ ){0,2}price", VENUE),
    _sentence(rf"(?:is|are) (?:\w+ )?(?:listed|quoted|traded|trading)\b", VENUE, SYMBOL),
    _sentence(r"(?:began|commenced|started) trading", NATIONAL, SYMBOL),
]
UNTRADED = [_sentence(rf"no (?:\w+ ){{0,3}}market (?:\w+ ){{0,3}}for (?:\w+ ){{0,3}}{SECURITY}", none=r"for (?:\w+ ){0,2}warrants|purchase warrants")]
# whether this is the first sale to the public
FIRST = [
    _sentence(r"this is (?:an|our|the) initial public offering"),
    _sentence(r"this prospectus (?:\w+ ){1,2}(?:our|the) initial public offering", none="since|after|following"),
    _sentence(r"we are offering", r"in (?:our|this) initial public offering"),
    *UNTRADED,
]
TO_BE_LISTED = [_sentence(r"appl(?:y|ied|ication)\b(?: \w+){0,5} list(?:ing|ed)?"), _sentence(r"approved\b(?: \w+){0,4} list(?:ing|ed)?"), _sentence("initial public offering price", r"exceeds|higher than", "book value")]
TO_THE_PUBLIC = [_sentence("initial public offering"), _sentence(r"this is (?:\w+ ){0,4}public offering of")]


def flat(text: Column) -> Column:
    """Entities decoded, characters without width off, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(decoded(F.coalesce(text, F.lit(""))), "[​-‍⁠﻿]", ""), r"\s+", " "))


def plain(flat_text: Column) -> Column:
    """Lower-case words and full stops; a percentage is one word; notes such as (1) are off."""
    t = F.replace(F.lower(flat_text), F.lit("u.s."), F.lit("us"))
    t = F.regexp_replace(F.regexp_replace(t, r"\(\d\)", " "), r"\d[\d.]*\s?%", " percentage ")
    return F.regexp_replace(F.regexp_replace(t, r"\.(?!\s|$)", " "), r"[^a-z0-9.]+", " ")


def cover(text: Column) -> Column:
    """A text up to and a little past its price table, else its beginning."""
    low = F.replace(F.lower(text), F.lit("proceeds, before"), F.lit("proceeds before"))
    ends = F.array_compact(F.array(*[F.when(F.instr(low, m) > 0, F.instr(low, m) + len(m) - 1) for m in TABLE_MARKS]))
    return F.substring(text, F.lit(1), F.coalesce(F.array_min(ends) + PAST_TABLE, F.lit(NO_TABLE)))


def sentences(plain_text: Column) -> Column:
    return F.transform(F.split(plain_text, r"\."), lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(s, " +", " ")), F.lit(" ")))


def says(plain_text: Column, statements: list[str]) -> Column:
    """Whether one of the statements is made in the text."""
    return reduce(lambda a, b: a | b, (plain_text.rlike(x) for x in statements))


def classify(on_cover: Column, anywhere: Column) -> Column:
    """ipo, follow_on or unknown, from the words of the cover and of the whole text. What has a price on a market is no first
    sale; a listing that is only sought makes one of an offering to the public."""
    first = says(on_cover, FIRST) | (says(anywhere, TO_BE_LISTED) & says(on_cover, TO_THE_PUBLIC))
    return pick((says(on_cover, TRADED), "follow_on"), (first, "ipo"), otherwise="unknown")


def offering_type(on_cover: Column, base: Column) -> Column:
    """The kind of offering: what is sold, then who sells it, then whether it is sold for the first time. base: what classify
    says."""
    by_issuer = says(on_cover, ISSUER)
    return pick(
        (says(on_cover, MERGER), "merger_proxy"), (says(on_cover, DEBT), "debt_offering"), (says(on_cover, DIRECT), "direct_listing"),
        (says(on_cover, SPIN_OFF) & ~says(on_cover, ISSUER[:1]), "spin_off_distribution"), (base == "follow_on", "follow_on"),
        (says(on_cover, RESALE) & ~by_issuer, "resale_only"), otherwise=base,
    )


def amounts(flat_text: Column) -> Column:
    """array<struct<before, value, after>> of the text's dollar amounts, in order. before reaches back to the last amount."""
    parts = F.split(F.lower(flat_text), r"\$")
    number = lambda p: F.regexp_replace(F.regexp_extract(p, r"^ ?([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    words = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\(\d\)|\bu\.?s\.?d?$|[,:;“”\"]", " "), r"\s+", " "))
    pair = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.struct(words(F.right(a, F.lit(240))).alias("before"), number(b).alias("value"), words(F.regexp_replace(F.left(b, F.lit(80)), r"^ ?[0-9.,]+", "")).alias("after")))
    return pair


#: What may stand between the price and its amount: words that describe the security, and a verb, which makes it a statement.
_OF = rf"(?: (?:of|per|for|the|our|each|in|this|total|initial|public|offering|class|[ab]|common|ordinary|american|depositary|{SECURITY}))*"
_IS = r"(?: (?:is|was|will be))"
_PRICE = r"\b(?:(?:public )?offering price|price to (?:the )?public|ipo price)"
#: On the cover: the price, with or without a verb. Further on: a statement, or a cell of a table. In looser words: any price per
#: share. A price that is assumed, or that somebody else pays, is none.
ON_COVER, STATED, CELL, LOOSE = rf"{_PRICE}{_OF}{_IS}?$", rf"{_PRICE}{_OF}{_IS}$", rf"(?:per {SECURITY}|total) (?:initial )?{_PRICE[2:]}$", rf"\bprice(?: of|{_IS})?$"
_PER_SHARE = rf"^per (?:\w+ ){{0,3}}{SECURITY}\b"
_OTHERWISE = r"par value|warrant|exercis|option|assum|based (?:up)?on"


def _first(found: Column, before: str, after: str | None = None) -> Column:
    """The first amount in the band of a price per share with the words before it, and those after it."""
    ok = lambda x: x["value"].between(*PRICE_BAND) & x["before"].rlike(before) & ~F.right(x["before"], F.lit(160)).rlike(_OTHERWISE)
    fits = (lambda x: ok(x) & x["after"].rlike(after)) if after else ok
    return F.try_element_at(F.filter(found, fits), F.lit(1))["value"]


def price_range(flat_text: Column, on_cover: Column) -> Column:
    """struct(low, high) of a range that the price is said to lie in, else of the price to the public; on_cover: amounts of
    the cover."""
    amount = r"\$ ?([0-9](?:[0-9,.]*[0-9])?)"
    between = rf"price (?:\S+ ){{0,12}}(?:between|range of|from) (?:us)?{amount} (?:and|to) (?:us)?{amount}"
    money = lambda g: F.regexp_replace(F.regexp_extract(F.lower(flat_text), between, g), ",", "").try_cast("double")
    low = F.coalesce(money(1), _first(on_cover, r"price to (?:the )?public(?: \S+){0,8}$"))
    return F.struct(low.alias("low"), F.coalesce(money(2), low).alias("high"))


def final_price(on_cover: Column, anywhere: Column) -> Column:
    """The price on the cover; one that a sentence states, or a table shows, anywhere; on the cover in looser words. Never a par
    value, a warrant's price, an assumption or a total. Both are amounts."""
    return F.coalesce(_first(on_cover, ON_COVER), _first(anywhere, rf"{STATED}|{CELL}"), _first(on_cover, LOOSE, _PER_SHARE))


def symbol(flat_text: Column) -> Column:
    """The symbol in capitals that follows the word; null if prose does."""
    return F.nullif(F.regexp_extract(flat_text, r"\b[Ss]ymbols?\W{0,4}([A-Z]{1,6})\b", 1), F.lit(""))


def lockup_days(found: Column) -> Column:
    """Days of the first sentence on a lock-up that names some."""
    told = F.filter(found, lambda s: F.contains(s, F.lit(" lock up ")) & s.rlike(r" [0-9]{2,3} days "))
    return F.regexp_extract(F.try_element_at(told, F.lit(1)), r" ([0-9]{2,3}) days ", 1).try_cast("int")


def dual_class(plain_text: Column) -> Column:
    """Whether shares are said to be of two classes; null where no class is mentioned."""
    return F.when(plain_text.rlike(r"\bclass(?:es)?\b"), plain_text.rlike(r"\bdual class\b"))


def read(filings: DataFrame, text_col: str) -> DataFrame:
    """filings with kind, base, price_low, price_high, final_price, symbol (all four null unless base is ipo), lockup_days
    and dual_class. Each step is a column of its own, so that a text is cleaned and cut once."""
    df = filings.withColumn("_flat", flat(F.col(text_col))).withColumn("_plain", plain(F.col("_flat")))
    df = df.withColumns({"_cover": cover(F.col("_plain")), "_near": amounts(cover(F.lower("_flat"))), "_far": amounts(F.col("_flat"))})
    df = df.withColumn("base", classify(F.col("_cover"), F.col("_plain"))).withColumn("_range", price_range(F.col("_flat"), F.col("_near")))
    found = {"kind": offering_type(F.col("_cover"), F.col("base")), "lockup_days": lockup_days(sentences(F.col("_plain"))), "dual_class": dual_class(F.col("_plain"))}
    first = {"price_low": F.col("_range.low"), "price_high": F.col("_range.high"), "final_price": F.coalesce(final_price(F.col("_near"), F.col("_far")), F.col("_range.high"), F.col("_range.low")), "symbol": symbol(F.col("_flat"))}
    df = df.withColumns(found | {k: F.when(F.col("base") == "ipo", v) for k, v in first.items()})
    return df.drop("_flat", "_plain", "_cover", "_near", "_far", "_range")


def is_blank_check(raw: Column) -> Column:
    """Whether the filer's industry, in the header's first 6,000 characters, is that of blank checks (code 6770)."""
    line = F.filter(F.split(F.substring(raw, 1, 6000), "\n"), lambda x: F.contains(x, F.lit("STANDARD INDUSTRIAL CLASSIFICATION")))
    return F.coalesce(F.exists(line, lambda x: F.contains(x, F.lit("[6770]"))), F.lit(False))
