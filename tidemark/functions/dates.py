"""Dates in many spellings, calendars, staleness and retry times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import pick

# Fixed: the spellings that dates come in, tried in this order after an ISO beginning.
SPELLINGS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd MMM yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy", "dd-MMM-yy")


def parsed(text: Column) -> Column:
    """A date from any of the spellings (month names in any case), else null."""
    t = F.trim(text)
    named = F.initcap(F.lower(F.regexp_replace(t, "-", " ")))  # 05-JAN-2024 as 05 Jan 2024
    named = F.when(F.substring(t, 3, 1) == "-", F.regexp_replace(named, " ", "-")).otherwise(named)
    iso = F.try_to_date(F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    shapes = {"dd-MMM-yyyy": r"^\d{2}-[A-Za-z]{3}-\d{4}$", "dd MMM yyyy": r"^\d{2} [A-Za-z]{3} \d{4}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "yyyyMMdd": r"^\d{8}$", "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$", "dd-MMM-yy": r"^\d{2}-[A-Za-z]{3}-\d{2}$"}
    return F.coalesce(iso, *[F.when(t.rlike(shape), F.try_to_date(named, spelling)) for spelling, shape in shapes.items()])


def keep_raw(text: Column) -> Column:
    """ISO where a date can be read, else the text as it is."""
    return F.coalesce(parsed(text).cast("string"), text)


def business_days(first: Column, last: Column) -> Column:
    return F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)


def open_day(opened: Column, today: Column, most: int = 5) -> Column:
    """Which business day of an offer today is, as a stage; no more than most."""
    n = F.when(today <= opened, 1).otherwise(F.least(F.lit(most), 1 + F.size(business_days(F.date_add(opened, 1), F.greatest(today, F.date_add(opened, 1))))))
    return F.when(opened.isNull(), "unknown").otherwise(F.concat(F.lit("day_"), n.cast("string")))


def freshness(age_hours: Column, live: float = 4, delayed: float = 48) -> Column:
    return pick((age_hours.isNull(), "UNKNOWN"), (age_hours <= live, "LIVE"), (age_hours <= delayed, "DELAYED"), otherwise="STALE")


def heartbeat(age_seconds: Column, interval: float) -> Column:
    return pick((age_seconds.isNull(), "UNKNOWN"), (age_seconds <= interval, "LIVE"), (age_seconds <= 3 * interval, "STALE"), otherwise="FAILED")


def week_key(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def back_off(attempts: Column) -> Column:
    return F.least(F.lit(3600.0), F.pow(F.lit(2.0), attempts) * 30).cast("long")


def available_from(opened: Column, closed: Column, listed: Column) -> Column:
    return F.coalesce(opened, closed, F.date_sub(listed, 1))


def window_start(today: Column, years: int = 5) -> Column:
    return F.add_months(today, -12 * years)


def months_apart(a: Column, b: Column) -> Column:
    return (F.year(a) * 12 + F.month(a)) - (F.year(b) * 12 + F.month(b))


def is_annual(start: Column, end: Column) -> Column:
    return F.datediff(end, start).between(350, 380)


def as_utc(naive: Column) -> Column:
    """A time without a zone as one of UTC, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive.cast("timestamp_ntz")).cast("timestamp")


def missing_days(have: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Business days between first and last that a ledger lacks."""
    spark = have.sparkSession
    days = spark.range(1).select(F.explode(business_days(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(day))
    return days.join(have.select(day).distinct(), day, "left_anti")
