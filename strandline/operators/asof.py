"""As-of date algebra.

A lookup puts targets and prices of an entity into one table, in order of their days, and carries the last price seen
along: one shuffle and a sort, whatever lies between two days; no range join, no row for days without a price. It works
for timestamps as well as for dates. Where a calendar serves very many lookups it can be made into a spine instead, a
row for every calendar day, and looked up by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the contract, in days: a weekly observation ends 6 days after its start and can be used 14 days after it.
PERIOD_DAYS, LAG_DAYS, REACH = 6, 14, 450


def annotate(weekly: DataFrame) -> DataFrame:
    """Contract dates of (entity, start, svi): period end, availability, signal date; partial rows dropped."""
    if "is_partial" in weekly.columns:
        weekly = weekly.filter(~F.coalesce("is_partial", F.lit(False))).drop("is_partial")
    sunday = F.assert_true(F.weekday("start") == 6, F.concat(F.lit("not a week start on Sunday: "), F.col("start").cast("string")))
    out = weekly.filter(sunday.isNull())
    ends = {"period_end": F.date_add("start", PERIOD_DAYS), "available_at": F.date_add("start", LAG_DAYS), "signal_date": F.date_add("start", LAG_DAYS)}
    return out.withColumns(ends)


def spine(prices: DataFrame, reach: int = REACH) -> DataFrame:
    """(entity, day, at_or_before, price_before, strictly_before, at_or_after, price_after) from (entity, date, close).

    ``reach`` days are added at both ends; a target beyond has no row, and so joins as null.
    """
    span = prices.groupBy("entity").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("entity", F.explode(F.sequence(F.date_sub("a", reach), F.date_add("b", reach))).alias("day"))
    joined = days.join(prices.select("entity", F.col("date").alias("day"), F.col("date").alias("td"), "close"), ["entity", "day"], "left")
    back = Window.partitionBy("entity").orderBy("day")
    # Frames that only grow are evaluated in one pass: what follows is a running last from the other end.
    ahead = Window.partitionBy("entity").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = back.rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        "entity", "day",
        F.last("td", True).over(upto).alias("at_or_before"), F.last("close", True).over(upto).alias("price_before"),
        F.last("td", True).over(past).alias("strictly_before"),
        F.last("td", True).over(ahead).alias("at_or_after"), F.last("close", True).over(ahead).alias("price_after"),
    )


#: What a lookup finds: the order of days, which of targets (1) and prices (0) of one day comes first, and the column.
LOOKUPS = {
    "at_or_before": (False, 0, "__date"), "price_before": (False, 0, "__close"), "strictly_before": (False, 1, "__date"), "price_strictly_before": (False, 1, "__close"),
    "at_or_after": (True, 0, "__date"), "price_after": (True, 0, "__close"),
}


def lookup(df: DataFrame, prices: DataFrame, entity: Column | str, day: Column, **columns: str) -> DataFrame:
    """Adds to each row of ``df`` what ``prices`` (entity, date, close) has around ``day``: ``new_name=`` a name of ``LOOKUPS``.

    Days and prices are the last (next) that are not null; a null day or entity, and an entity without prices, give
    nulls. All columns of one call share a shuffle; rows of ``df`` stay as they are, repeated ones too.
    """
    entity = F.col(entity) if isinstance(entity, str) else entity
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    targets = df.select(entity.alias("__e"), day.alias("__d"), F.lit(1).alias("__t"), row.alias("__row"))
    known = prices.filter(F.col("entity").isNotNull() & F.col("date").isNotNull())
    known = known.select(F.col("entity").alias("__e"), F.col("date").alias("__d"), F.lit(0).alias("__t"), F.col("date").alias("__date"), F.col("close").alias("__close"))
    both = targets.unionByName(known, allowMissingColumns=True)
    found = {}
    for name, kind in columns.items():
        late, first, column = LOOKUPS[kind]
        tie = F.col("__t").desc() if first else F.col("__t").asc()
        w = Window.partitionBy("__e").orderBy(F.col("__d").desc() if late else F.col("__d").asc(), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found[f"__found_{name}"] = F.last(column, True).over(w)
    out = both.withColumns(found).filter(F.col("__t") == 1)
    asked = F.col("__d").isNotNull() & F.col("__e").isNotNull()
    return out.select("__row.*", *[F.when(asked, F.col(f"__found_{n}")).alias(n) for n in columns])


def lookup_one(df: DataFrame, prices: DataFrame, entity: str, day: Column, **columns: str) -> DataFrame:
    """``lookup`` of all rows in one entity's prices: each distinct day is looked up once, so that rows do not meet there."""
    days = df.select(day.alias("__day")).filter(F.col("__day").isNotNull()).distinct()
    found = lookup(days, prices.filter(F.col("entity") == entity), F.lit(entity), F.col("__day"), **columns)
    return df.withColumn("__at", day).join(found, F.col("__at") == F.col("__day"), "left").drop("__at", "__day")


def snap(df: DataFrame, calendar: DataFrame, entity: Column | str, day: Column, **columns: str) -> DataFrame:
    """Adds ``new_name=column`` of the calendar at (entity, day): by ``lookup`` in prices, or by a join with a spine."""
    if "day" not in calendar.columns:
        return lookup(df, calendar, entity, day, **columns)
    side = calendar.select(F.col("entity").alias("__e"), F.col("day").alias("__d"), *[F.col(c).alias(n) for n, c in columns.items()])
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.join(side, (entity == F.col("__e")) & (day == F.col("__d")), "left").drop("__e", "__d")


def window_return(start: str, end: str, p0: str, p1: str) -> Column:
    """Return between two dates; null if either is missing, the end is not after the start, or the first price is 0."""
    return F.when(F.col(end) > F.col(start), F.col(p1) / F.nullif(F.col(p0), F.lit(0.0)) - 1)


def trailing_return(df: DataFrame, calendar: DataFrame, entity: Column | str, end: str, weeks: str, out: str) -> DataFrame:
    """Return over ``weeks`` weeks to the snapped ``end``; the start counts back from the snapped end."""
    df = snap(df, calendar, entity, F.col(end), __t1="at_or_before", __p1="price_before")
    df = snap(df, calendar, entity, F.date_sub("__t1", F.col(weeks) * 7), __t0="at_or_before", __p0="price_before")
    return df.withColumn(out, window_return("__t0", "__t1", "__p0", "__p1")).drop("__t0", "__t1", "__p0", "__p1")


def skip_return(df: DataFrame, calendar: DataFrame, entity: Column | str, end: str, total: int, skip: int, out: str) -> DataFrame:
    """Return from ``total`` to ``skip`` weeks before ``end``, both counted from the unsnapped end."""
    df = snap(df, calendar, entity, F.date_sub(end, 7 * skip), __t1="at_or_before", __p1="price_before")
    df = snap(df, calendar, entity, F.date_sub(end, 7 * total), __t0="at_or_before", __p0="price_before")
    return df.withColumn(out, window_return("__t0", "__t1", "__p0", "__p1")).drop("__t0", "__t1", "__p0", "__p1")


def forward_return(df: DataFrame, calendar: DataFrame, entity: Column | str, start: str, weeks: str, out: str, out_end: str) -> DataFrame:
    """Return over ``weeks`` weeks from the first day at or after ``start``; the end day stands even where the return is null."""
    df = snap(df, calendar, entity, F.col(start), __t0="at_or_after", __p0="price_after")
    df = snap(df, calendar, entity, F.date_add("__t0", F.col(weeks) * 7), __t1="at_or_after", __p1="price_after")
    df = df.withColumn(out, window_return("__t0", "__t1", "__p0", "__p1")).withColumn(out_end, F.col("__t1"))
    return df.drop("__t0", "__t1", "__p0", "__p1")


def violations(columns: list[str]) -> dict[str, Column]:
    """Each rule's violation as a condition; a null date breaks rules 1 and 2 and passes the others."""
    bad = lambda c, null=False: F.coalesce(c, F.lit(null))
    c = F.col
    rules = {
        "r01_start_not_sunday": bad(F.weekday("start") != 6, True),
        "r02_period_end": bad(c("period_end") != F.date_add("start", 6), True),
        "r03_available_early": bad(c("available_at") < F.date_add("start", 14)),
        "r04_signal_before_available": bad(c("signal_date") < c("available_at")),
        "r05_traded_before_signal": bad(c("first_tradeable_at") < c("signal_date")),
        "r06_feature_not_before_trade": bad(c("feature_date") >= c("first_tradeable_at")),
        "r07_return_before_trade": bad(c("return_start") < c("first_tradeable_at")),
        "r08_return_in_period": bad(c("return_start") <= c("period_end")),
    }
    if "z_window_end" in columns:
        rules["r09_z_window_late"] = bad(c("z_window_end") > c("period_end"))
    for name in columns:
        if name.startswith("return_end_") and name.endswith("w"):
            n = int(name[11:-1])
            rules[f"r10_return_end_{n}w"] = bad(c(name) < F.date_add("return_start", 7 * n))
    return rules


REQUIRED = ("start", "period_end", "available_at", "signal_date", "first_tradeable_at", "feature_date", "return_start")


def count_violations(panel: DataFrame) -> DataFrame:
    """(rule, n) of every rule in one pass; rule 0, missing columns, is an error at once."""
    if missing := [x for x in REQUIRED if x not in panel.columns]:
        raise ValueError(f"contract columns are missing: {missing}")
    rules = violations(panel.columns)
    sums = panel.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(k) for k, v in rules.items()])
    return sums.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))])).alias("rule", "n"))


def assert_contract(panel: DataFrame) -> DataFrame:
    """The panel itself; a row that breaks a rule stops the job that reads it."""
    if missing := [x for x in REQUIRED if x not in panel.columns]:
        raise ValueError(f"contract columns are missing: {missing}")
    broken = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in violations(panel.columns).items()]))
    return panel.filter(F.assert_true(F.size(broken) == 0, F.concat(F.lit("look-ahead contract broken: "), F.concat_ws(", ", broken))).isNull())
