"""Null rules and small numeric curves, as Column to Column functions that stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 50.0


def truthy(c: Column) -> Column:
    """A number that counts: zero is as good as missing."""
    return F.nullif(c, F.lit(0).cast("double"))


def text_or_null(c: Column) -> Column:
    """Empty text means missing."""
    return F.nullif(c, F.lit(""))


def price_of(final: Column, high: Column) -> Column:
    return F.coalesce(truthy(final), truthy(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is missing or b is zero."""
    return F.try_divide(a, b)


def growth_pct(now: Column, before: Column) -> Column:
    return (ratio(now, before) - 1) * 100


def between(c: Column, low: float, high: float) -> Column:
    """c, held between two bounds. Missing stays missing, which greatest() and least() alone would turn into a bound."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def neutral_if_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(NEUTRAL))


def linear(c: Column, low: float, high: float) -> Column:
    """0 at low, 100 at high, clamped; low may exceed high. Missing is neutral."""
    return neutral_if_missing(between((c - low) / (high - low) * 100, 0, 100))


def five_star(c: Column) -> Column:
    return neutral_if_missing(between(c * 20, 0, 100))


def mean_known(*cs: Column) -> Column:
    """The mean of what is known; neutral if nothing is."""
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cs))
    return neutral_if_missing(ratio(reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cs)), n))


# Up to which multiple a line holds, its value at the line's start, and its slope.
SUBSCRIPTION = ((1, 0, 0.0, 35.0), (3, 1, 35.0, 8.0), (10, 3, 51.0, 2.3), (25, 10, 67.0, 0.8), (50, 25, 79.0, 0.4), (100, 50, 89.0, 0.14))
SUBSCRIPTION_FLOOR, SUBSCRIPTION_TOP = 10.0, 97.0


def subscription(c: Column) -> Column:
    """How well an offer is subscribed, by a piecewise line with small steps at 10 and 100 times."""
    out = F.when(c.isNull(), NEUTRAL)
    for upto, start, value, slope in SUBSCRIPTION:
        out = out.when(c < upto, F.greatest(F.lit(value) + (c - start) * slope, F.lit(SUBSCRIPTION_FLOOR)))
    return out.otherwise(SUBSCRIPTION_TOP)


def logistic(score: Column, middle: float, scale: float) -> Column:
    """A percentage between 2 and 98."""
    return between(100 / (1 + F.exp(-(score - middle) / scale)), 2, 98)


def steady(c: Column, digits: int = 6) -> Column:
    """Rounds half up on the binary value, the same way in any engine."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


def pick(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = reduce(lambda a, r: a.when(*r), rules[1:], F.when(*rules[0]))
    return out.otherwise(otherwise)


def listed(*items: tuple[Column, Column | str], most: int | None = None) -> Column:
    """The texts whose conditions hold, in order."""
    found = F.filter(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in items]), lambda x: x.isNotNull())
    return F.slice(found, 1, most) if most else found
