"""The (entity, week) panel: contract dates, attention, returns and price features as known at the signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import ratio, rounded, wide
from strandline.sources.facts import MARKET

from . import asof, features

PAST, AHEAD = (1, 4, 8, 12, 26), (1, 2, 4)


def signals(attention: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weeks that can be traded: mean known, a trading day at or after the signal, and one before that."""
    df = attention.filter(F.col("ma52").isNotNull()).withColumn("week", F.col("signal_date"))
    df = asof.snap(df, calendar, "entity", F.col("signal_date"), first_tradeable_at="at_or_after")
    df = asof.snap(df, calendar, "entity", F.col("first_tradeable_at"), feature_date="strictly_before")
    df = df.filter(F.col("first_tradeable_at").isNotNull() & F.col("feature_date").isNotNull())
    return df.withColumn("return_start", F.col("first_tradeable_at")).withColumn("z_window_end", F.col("period_end"))


def _at_once(df: DataFrame, prices: DataFrame, targets: dict[str, Column], day: str, price: str) -> DataFrame:
    """(entity, week, <name>_day and <name>_price for each target day): all targets of a row are rows of one lookup."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), d.alias("target")) for k, d in targets.items()]))
    long = df.select("entity", "week", each.alias("x")).select("entity", "week", "x.*")
    long = asof.lookup(long, prices, "entity", F.col("target"), found=day, close=price)
    names = list(targets)
    return long.groupBy("entity", "week").agg(*wide("what", F.col("found"), names, "{}_day"), *wide("what", F.col("close"), names, "{}_price"))


def past_returns(sig: DataFrame, calendar: DataFrame, weeks: tuple[int, ...] = PAST) -> DataFrame:
    """Trailing returns for all horizons at once: horizons are rows, looked up together, then turned into columns."""
    long = sig.select("entity", "week", "feature_date", F.explode(F.array(*map(F.lit, weeks))).alias("n"))
    long = asof.trailing_return(long, calendar, "entity", "feature_date", "n", "r")
    return long.groupBy("entity", "week").agg(*wide("n", rounded(F.col("r"), 4), list(weeks), "past_{}w"))


def looking_back(sig: DataFrame, prices: DataFrame, weeks: tuple[int, ...] = PAST, total: int = 52, skip: int = 4) -> DataFrame:
    """(entity, week, past_{n}w, weekly_return, market_weekly_return, past_52w_skip4w): returns up to the feature date.

    The date is snapped once; then the starts of all horizons, counted from there, and both ends of the return that skips
    the last weeks, counted from the date itself, are looked up together.
    """
    one = asof.lookup(sig.select("entity", "week", "feature_date"), prices, "entity", F.col("feature_date"), t1="at_or_before", p1="price_before")
    starts = {f"n{n}": F.date_sub("t1", 7 * n) for n in {*weeks, 1}}
    found = _at_once(one, prices, {**starts, "total": F.date_sub("feature_date", 7 * total), "skip": F.date_sub("feature_date", 7 * skip)}, "at_or_before", "price_before")
    one = asof.lookup_one(one, prices, MARKET, F.col("feature_date"), m1="at_or_before", q1="price_before")
    one = asof.lookup_one(one, prices, MARKET, F.date_sub("m1", 7), m0="at_or_before", q0="price_before")
    one = one.join(found, ["entity", "week"])
    back = {f"past_{n}w": rounded(asof.window_return(f"n{n}_day", "t1", f"n{n}_price", "p1"), 4) for n in weeks}
    return one.select(
        "entity", "week", *[c.alias(n) for n, c in back.items()],
        rounded(asof.window_return("n1_day", "t1", "n1_price", "p1"), 4).alias("weekly_return"), rounded(asof.window_return("m0", "m1", "q0", "q1"), 4).alias("market_weekly_return"),
        rounded(asof.window_return("total_day", "skip_day", "total_price", "skip_price"), 4).alias("past_52w_skip4w"),
    )


def ahead_returns(sig: DataFrame, prices: DataFrame, weeks: tuple[int, ...] = AHEAD) -> DataFrame:
    """Forward returns of entity and market (each on its own calendar), excess of the unrounded two, end days."""
    one = asof.lookup(sig.select("entity", "week", "first_tradeable_at"), prices, "entity", F.col("first_tradeable_at"), t0="at_or_after", p0="price_after")
    found = _at_once(one, prices, {f"n{n}": F.date_add("t0", 7 * n) for n in weeks}, "at_or_after", "price_after")
    one = asof.lookup_one(one, prices, MARKET, F.col("first_tradeable_at"), m0="at_or_after", q0="price_after").join(found, ["entity", "week"])
    ends, own, excess = [], [], []
    for n in weeks:
        one = asof.lookup_one(one, prices, MARKET, F.date_add("m0", 7 * n), **{f"m{n}_day": "at_or_after", f"m{n}_price": "price_after"})
        r, m = asof.window_return("t0", f"n{n}_day", "p0", f"n{n}_price"), asof.window_return("m0", f"m{n}_day", "q0", f"m{n}_price")
        ends.append(F.col(f"n{n}_day").alias(f"return_end_{n}w"))
        own.append(rounded(r, 4).alias(f"future_{n}w"))
        excess.append(rounded(r - m, 4).alias(f"future_excess_{n}w"))
    return one.select("entity", "week", *ends, *own, *excess)


def build(attention: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """The panel. ``prices`` has price_features and industry; ``calendar`` (entity, date, close) the entities and the market."""
    sig = signals(attention, calendar)
    back = looking_back(sig, calendar).withColumn("weekly_excess", rounded(F.col("weekly_return") - F.col("market_weekly_return"), 4))
    day = prices.select(
        "entity", "industry", F.col("date").alias("feature_date"),
        rounded(F.when(F.col("vol_ma20") > 0, ratio(F.col("volume"), F.col("vol_ma20"))), 4).alias("volume_ratio_4w"),
        rounded(F.when(F.col("vol_ma60") > 0, ratio(F.col("volume"), F.col("vol_ma60"))), 4).alias("volume_ratio_12w"),
        rounded("turnover_ma20", 0).alias("turnover"), rounded("money", 0).alias("trading_value"),
        rounded("volatility_20", 4).alias("volatility_4w"), rounded("volatility_60", 4).alias("volatility_12w"),
        rounded("beta", 4).alias("beta_26w"), rounded("max_drawdown", 4).alias("max_drawdown_12w"),
    )
    df = sig.withColumns({
        "is_event_z2": F.coalesce(F.col("z") > 2.0, F.lit(False)), "is_event_ratio": F.coalesce(F.col("shock") > 1.0, F.lit(False)),
        "z": rounded("z", 4), "shock": rounded("shock", 4), "ma52": rounded("ma52", 3), "std52": rounded("std52", 3), "lag_days": F.datediff("available_at", "start"),
    })
    df = df.join(back, ["entity", "week"]).join(ahead_returns(sig, calendar), ["entity", "week"])
    df = df.join(day, ["entity", "feature_date"], "left")
    return df.withColumn("liquidity_rank", average_rank("turnover", ["week"]))


def average_rank(column: str, by: list[str], descending: bool = True) -> Column:
    """Rank within ``by``, ties sharing their mean rank, null where the value is."""
    x = F.col(column)
    w = Window.partitionBy(*by)
    place = F.rank().over(w.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), place + (same - 1) / 2)


def coverage(panel: DataFrame, universe: DataFrame, least: int = 26) -> DataFrame:
    """(entity, n_rows, n_forward, status) for every entity of the universe."""
    got = panel.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"), F.count("future_4w").alias("n_forward"))
    df = universe.select("entity").distinct().join(got, "entity", "left").na.fill(0)
    # Names of the statuses.
    status = F.when(F.col("n_rows") == 0, "blocked_panel_build_error").when(F.col("n_rows") < least, "blocked_insufficient_history").when(F.col("n_forward") < least, "blocked_insufficient_forward_history").otherwise("accepted")
    return df.withColumn("status", status)


def input_coverage(universe: DataFrame, interest: DataFrame, prices: DataFrame, market: DataFrame, panel: DataFrame, least: int = 26) -> DataFrame:
    """(entity, status, reason, trends_present, price_present, benchmark_present, n_rows, n_forward, least) of the universe.

    Checked in turn: a benchmark at all, a valid interest series (starts on Sundays), valid prices (dated, with a
    close), both there, rows in the panel, enough of them (``least``), enough with a forward return. ``reason`` says what
    was found, and is empty for an accepted entity; rows are counted only of entities whose inputs are there and valid.
    """
    bad = interest.groupBy("entity").agg(F.count_if(F.coalesce(F.weekday("start") != 6, F.lit(True))).alias("bad_weeks"))
    closes = prices.groupBy("entity").agg(F.count_if(F.col("date").isNull() | F.col("close").isNull()).alias("bad_days"))
    got = panel.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.count("future_excess_4w").alias("ahead"))
    known = market.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("benchmark"))
    df = universe.select("entity").distinct().join(bad, "entity", "left").join(closes, "entity", "left").join(got, "entity", "left").crossJoin(F.broadcast(known))  # one row
    n, ahead = F.coalesce("rows", F.lit(0).cast("long")), F.coalesce("ahead", F.lit(0).cast("long"))
    trends, price = F.col("bad_weeks").isNotNull(), F.col("bad_days").isNotNull()
    # Names of the statuses.
    found = [
        (F.col("benchmark") == 0, "blocked_missing_benchmark", F.lit("no benchmark")),
        (F.col("bad_weeks") > 0, "blocked_invalid_trends_input", F.format_string("%d weeks do not start on a Sunday", "bad_weeks")),
        (F.col("bad_days") > 0, "blocked_invalid_price_input", F.format_string("%d days without a date or close", "bad_days")),
        (~(trends & price), "blocked_missing_raw_input", F.concat(F.lit("missing: "), F.concat_ws(", ", F.when(~trends, "trends"), F.when(~price, "price")))),
        (n == 0, "blocked_panel_build_error", F.lit("no row in the panel")),
        (n < least, "blocked_insufficient_history", F.format_string("only %d rows in the panel", n)),
        (ahead < least, "blocked_insufficient_forward_history", F.format_string("only %d rows with a forward return", ahead)),
    ]
    status, reason = F.lit("accepted"), F.lit("")
    for condition, name, text in reversed(found):
        status, reason = F.when(condition, name).otherwise(status), F.when(condition, text).otherwise(reason)
    raw = ("blocked_missing_benchmark", "blocked_invalid_trends_input", "blocked_invalid_price_input", "blocked_missing_raw_input")
    df = df.withColumn("status", status).withColumn("reason", reason)
    counted = lambda c: F.when(~F.col("status").isin(*raw), c).otherwise(F.lit(0).cast("long"))
    return df.select("entity", "status", "reason", trends.alias("trends_present"), price.alias("price_present"), (F.col("benchmark") > 0).alias("benchmark_present"), counted(n).alias("n_rows"), counted(ahead).alias("n_forward"), F.lit(least).alias("least"))


def assert_complete(coverage_: DataFrame, expected: int) -> None:
    """Fail unless every configured entity is accepted: a partial universe would be one of survivors."""
    r = coverage_.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("status") != "accepted").cast("int")), F.lit(0)).alias("bad")).first()
    if r["n"] != expected or r["bad"]:
        raise ValueError(f"partial survivor universe: {r['n']} of {expected} entities, {r['bad']} not accepted")


def provenance(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities"), F.min("week").alias("first_week"), F.max("week").alias("last_week"))
