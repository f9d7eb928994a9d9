"""As-of joins and return windows.

Spark has no as-of join. Events and observations are put into one frame and each event takes the last (or next)
observation of its key from a window over time: one shuffle by key and one sort, no pairs. A key with very many rows is
split by spans of time: windows then hold one span each, and what no observation of its own span answers is taken from the
nearest span that has one, which is found over one row per span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(events: DataFrame, bars: DataFrame, keys: list[str], at: str, ts: str, values: list[str], *, forward: bool = False, strict: bool = False, most: Column | None = None, prefix: str = "", span: int | None = None) -> DataFrame:
    """events with values (and ts as <prefix>ts) of the last bar of their key at or before at (strict: before it), or with
    forward of the first at or after it (strict: after). most: how far away the bar may be, in the units of at. Of bars
    with equal ts the one with the greatest values is taken. span: days (or units of a number) of a part of a key; without
    it a key is one window."""
    side = "_side"
    found = f"{prefix}bar"
    # at equal times, a bar stands before an event that may see it and after one that may not
    bar_first = not strict
    order_bar, order_event = (0, 1) if bar_first != forward else (1, 0)
    left = events.withColumns({"_t": F.col(at), side: F.lit(order_event), found: F.lit(None).cast(_kind(bars, ts, values))})
    seen = bars.groupBy(*keys, ts).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, F.col(ts).alias("_t"), F.lit(order_bar).alias(side), F.struct(F.col(ts).alias("ts"), *[F.col(f"_v.{v}").alias(v) for v in values]).alias(found))
    both = left.withColumn("_event", F.lit(True)).unionByName(seen.withColumn("_event", F.lit(False)), allowMissingColumns=True)
    number = F.unix_date("_t") if dict(bars.dtypes)[ts] == "date" else F.col("_t")
    both = both.withColumn("_span", F.floor(number / span) if span else F.lit(0))
    # time is walked backwards for the next bar: a frame that ends at its row grows, one that begins there is read anew for
    # every row
    way = F.desc if forward else F.asc
    w = Window.partitionBy(*keys, "_span").orderBy(way("_t"), way(side)).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(found, F.last(found, ignorenulls=True).over(w)).filter("_event")
    if span:
        ends = (F.min_by if forward else F.max_by)(found, F.when(~F.col("_event"), F.col("_t")))
        spans = both.groupBy(*keys, "_span").agg(ends.alias("_end"))
        v = Window.partitionBy(*keys).orderBy(way("_span")).rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("_end", F.last("_end", ignorenulls=True).over(v)).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_span": "_s"})
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_span") == F.col("_s")]
        out = out.join(spans, same, "left").withColumn(found, F.coalesce(found, "_end"))
    if most is not None:
        gap = (F.col(f"{found}.ts") - F.col(at)) if forward else (F.col(at) - F.col(f"{found}.ts"))
        out = out.withColumn(found, F.when(gap <= most, F.col(found)))
    return out.select(*events.columns, F.col(f"{found}.ts").alias(f"{prefix}ts"), *[F.col(f"{found}.{v}").alias(f"{prefix}{v}") for v in values])


def _kind(bars: DataFrame, ts: str, values: list[str]) -> str:
    kinds = dict(bars.dtypes)
    return "struct<" + ",".join([f"ts:{kinds[ts]}", *(f"`{v}`:{kinds[v]}" for v in values)]) + ">"


#: Fixed: rules of availability that a prediction may rest on, and those that only research may use.
POINT_IN_TIME = ("prospectus_filing", "nse_live_feed", "market_index_close")
RESEARCH_ONLY = ("xbrl_post_ipo_comparative", "first_periodic_report")


def known_at(events: DataFrame, observations: DataFrame, keys: list[str], at: str, *, research: bool = False) -> DataFrame:
    """events with the value of the latest period that was available at the time: available_at <= at under a rule that is
    listed; with research also comparatives whose period had ended. Any other rule is refused. Columns of observations:
    keys, period_end, available_at, rule, value."""
    o = observations.filter(F.col("value").isNotNull())
    seen = _running(events, o.filter(F.col("rule").isin(*POINT_IN_TIME)), keys, at, "available_at", "_best")
    if research:
        seen = _running(seen, o.filter(F.col("rule").isin(*RESEARCH_ONLY)), keys, at, "period_end", "_more")
        seen = seen.withColumn("_best", F.greatest("_best", "_more"))
    return seen.select(*events.columns, F.col("_best.value").alias("value"), F.col("_best.period_end").alias("period_end"))


def _running(events: DataFrame, observations: DataFrame, keys: list[str], at: str, since: str, out: str) -> DataFrame:
    """events with the greatest (period_end, available_at, value) of their key's observations whose day since is at most at:
    a running maximum over time, no pairs."""
    best = F.struct("period_end", F.coalesce(F.col("available_at"), F.lit("0001-01-01").cast(dict(observations.dtypes)["available_at"])).alias("available_at"), "value")
    rows = observations.filter(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_t")).agg(F.max(best).alias(out)).withColumn("_event", F.lit(False))
    both = events.withColumns({"_t": F.col(at), "_event": F.lit(True)}).unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_event").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.max(out).over(w)).filter("_event").drop("_t", "_event")


# Fixed: days of the forward windows, and how a first bar may lie around a stated listing date.
WINDOWS = {"return_7d": 7, "return_30d": 30, "return_90d": 90, "return_6m": 182, "return_12m": 365, "return_24m": 730}
BEFORE_DAYS, AFTER_DAYS = 4, 14
IMPLAUSIBLE = 2000.0


def split_factor(splits: Column, since: Column) -> Column:
    """The product of the factors of splits (array<struct<day, factor>>) after a day."""
    return F.aggregate(F.filter(F.coalesce(splits, F.array().cast("array<struct<day:date,factor:double>>")), lambda s: s["day"] > since), F.lit(1.0), lambda a, s: a * s["factor"])


def forward_returns(issues: DataFrame, bars: DataFrame, key: str, listed: str = "listed", price: str = "price", splits: str | None = None) -> DataFrame:
    """Returns of each issue from its listing session. issues: key, listed (date), price (offer, may be null); bars: key,
    day, open, close (null closes are passed over).

    The session is the key's first bar if that lies from four days before to fourteen after the stated date, else the
    first bar on or after it, if no more than fourteen days later. Returns are from the offer price, adjusted for later
    splits, else from the session's close; one that is beyond belief is suppressed and the close taken instead. A window
    whose day lies after the last bar is null, never zero. Bars meet issues once, and are summed up by window."""
    b = bars.filter("close is not null").select(key, "day", "open", "close")
    edge = b.groupBy(key).agg(F.min(F.struct("day", "open", "close")).alias("first"), F.max(F.struct("day", "close")).alias("last"))
    own = [c for c in issues.columns if c != key]
    later = asof(issues.filter(F.col(key).isNotNull()), b, [key], listed, "day", ["open", "close"], forward=True, prefix="_")
    anchored = later.join(edge, key)
    is_first = F.col("first.day").between(F.date_sub(listed, BEFORE_DAYS), F.date_add(listed, AFTER_DAYS))
    session = F.when(is_first, F.col("first")).when(F.datediff("_ts", listed) <= AFTER_DAYS, F.struct(F.col("_ts").alias("day"), F.col("_open").alias("open"), F.col("_close").alias("close")))
    anchored = anchored.withColumn("session", session).filter("session is not null").drop("first", "_ts", "_open", "_close")
    factor = split_factor(F.col(splits), F.col("session.day")) if splits else F.lit(1.0)
    offer = F.nullif(F.col(price), F.lit(0.0)) * factor
    close = F.nullif(F.col("session.close"), F.lit(0.0))
    first_return = (close / offer - 1) * 100
    good = F.coalesce(F.abs(first_return) <= IMPLAUSIBLE, F.lit(True)) & offer.isNotNull()
    anchored = anchored.withColumns({"base": F.when(good, offer).otherwise(close), "from_offer": good, "listing_return": F.when(good, first_return), "open_return": F.when(good, (F.nullif(F.col("session.open"), F.lit(0.0)) / offer - 1) * 100), "day_return": (close / F.nullif(F.col("session.open"), F.lit(0.0)) - 1) * 100})
    # the closes of all windows come by one as-of join: a row per window, put together again by what the issue is
    ends = F.explode(F.create_map(*[x for w, d in WINDOWS.items() for x in (F.lit(w), F.date_add(F.col("session.day"), d))])).alias("_w", "_end")
    asked = anchored.select(key, F.col("session.day").alias("_since"), ends).distinct()
    held = asof(asked, b, [key], "_end", "day", ["close"], prefix="_").filter(F.col("_ts") > F.col("_since"))
    found = held.groupBy(key, "_since").agg(*[F.max(F.when(F.col("_w") == w, F.col("_close"))).alias(f"_{w}") for w in WINDOWS])
    out = anchored.withColumn("_since", F.col("session.day")).join(found, [key, "_since"], "left")
    windows = {w: F.when(F.date_add("_since", d) <= F.col("last.day"), (F.col(f"_{w}") / F.col("base") - 1) * 100) for w, d in WINDOWS.items()}
    out = out.withColumns(windows | {"since_listing": (F.nullif(F.col("last.close"), F.lit(0.0)) / F.col("base") - 1) * 100, "session_day": F.col("_since"), "last_day": F.col("last.day")})
    return out.select(key, *own, "base", "from_offer", "listing_return", "open_return", "day_return", *WINDOWS, "since_listing", "session_day", "last_day")


def on_calendar(events: DataFrame, series: DataFrame, at: str, ts: str, value: str, out: str, *, forward: bool = False) -> DataFrame:
    """events with the value of one short series (a market's closes, a row a day) at or before at, or at or after it. The
    series is spread over the days from its first to its last, so its size is bounded by the calendar, and broadcast."""
    days = series.filter(F.col(value).isNotNull()).groupBy(F.col(ts).alias("_day")).agg(F.max(value).alias("_v"))
    edge = days.agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    every = edge.filter("_first is not null").select(F.explode(F.sequence("_first", "_last")).alias("_day"))
    near = Window.orderBy(F.desc("_day") if forward else F.asc("_day")).rowsBetween(Window.unboundedPreceding, 0)
    dense = every.join(F.broadcast(days), "_day", "left").select("_day", F.last("_v", ignorenulls=True).over(near).alias(out))
    clamped = F.greatest(F.col(at), F.col("_first")) if forward else F.least(F.col(at), F.col("_last"))
    keyed = events.join(F.broadcast(edge), F.lit(True), "left").withColumn("_day", F.when(F.col(at).isNotNull(), clamped))
    return keyed.join(F.broadcast(dense), "_day", "left").select(*events.columns, out)


# Fixed: what return windows can read of a series.
RECENT_DAYS, LISTING_DAYS, SLACK_DAYS, TARGET_DAYS = 20, 21, 12, (30, 90, 182, 365, 730)


def readable(day: Column, listed: Column, today: Column) -> Column:
    """Whether a return window could read a bar of that day; all others can be dropped without changing any return."""
    near = F.exists(F.array(*map(F.lit, TARGET_DAYS)), lambda w: day.between(F.date_add(listed, w - SLACK_DAYS), F.date_add(listed, w)))
    return (day >= F.date_sub(today, RECENT_DAYS)) | F.coalesce(day.between(listed, F.date_add(listed, LISTING_DAYS)) | near, F.lit(False))


def trailing_count(df: DataFrame, by: str, day: str, days: int, out: str = "n") -> DataFrame:
    """How many rows of the same group lie in the days before each row's day, that day itself left out. Counted from daily
    totals, so a window holds one row per day however many rows a day has."""
    daily = df.groupBy(by, day).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy(F.unix_date(day)).rangeBetween(-days, -1)
    return df.join(daily.select(by, day, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(out)), [by, day])


# Fixed: days looked back for the market's return, returns in its volatility, and how stale a close may be.
LOOKBACK, VOLATILITY, STALE_DAYS = 60, 20, 7


def volatility(bars: DataFrame, key: str) -> DataFrame:
    """bars (key, day, close) with vol: the yearly deviation of the last 20 log returns, in percent; null until there are 20."""
    w = Window.partitionBy(key).orderBy("day")
    r = bars.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(w)))
    last = w.rowsBetween(1 - VOLATILITY, 0)
    return r.withColumn("vol", F.when(F.count("_r").over(last) == VOLATILITY, F.stddev_samp("_r").over(last) * F.sqrt(F.lit(252.0)) * 100)).drop("_r")


def regime(issues: DataFrame, bars: DataFrame, key: str, at: str) -> DataFrame:
    """issues with the market's 60-day return and 20-day volatility from closes strictly before a day, none older than a
    week; null where the series doesn't cover that."""
    b = volatility(bars.filter("close is not null"), key).withColumn("_d", F.unix_date("day"))
    e = issues.withColumn("_at", F.unix_date(at))
    last = asof(e, b, [key], "_at", "_d", ["close", "vol"], strict=True, most=F.lit(STALE_DAYS), prefix="last_")
    back = last.withColumn("_from", F.col("last_ts") - LOOKBACK)
    base = asof(back, b, [key], "_from", "_d", ["close"], forward=True, most=F.lit(STALE_DAYS), prefix="base_")
    whole = F.col("last_vol").isNotNull() & F.col("base_close").isNotNull() & (F.col("base_ts") < F.col("last_ts"))
    return base.select(*issues.columns, F.when(whole, (F.col("last_close") / F.col("base_close") - 1) * 100).alias("market_return_60d"), F.when(whole, F.col("last_vol")).alias("market_vol_20d"))
