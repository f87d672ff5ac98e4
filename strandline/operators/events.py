"""Event study: flags, non-overlapping events, offset windows, abnormal returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources import store

from . import asof
from .crosssec import quantile_flag

PRE, POST, GAP_DAYS = 4, 8, 28


def flagged(panel: DataFrame) -> DataFrame:
    """Adds is_event_top: above the week's 90 % quantile of the rounded z."""
    return quantile_flag(panel, "z", 0.9, "is_event_top")


DEFINITIONS = ("z2", "ratio", "top")


def defined(panel: DataFrame) -> DataFrame:
    """(definition, entity, week, return_start, z) of the raw events of all definitions; ``panel`` is flagged."""
    names = F.array(*[F.when(F.col(f"is_event_{d}"), F.lit(d)) for d in DEFINITIONS])
    return panel.withColumn("definition", F.explode(F.array_compact(names))).select("definition", "entity", "week", "return_start", "z")


def non_overlapping(events: DataFrame, gap: int = GAP_DAYS, by: tuple[str, ...] = ("entity",), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events of an entity at least ``gap`` days after the last one kept, the first one being kept.

    Each week with an event points to the first one ``gap`` days or more later. What is kept is what can be reached from
    the first, found by doubling: in each round the reached weeks reach on by their pointers, and pointers become pointers
    of pointers. So an entity's events need not meet in a row or task, and rounds are the logarithm of what is kept.
    Tables between rounds are stored (``keep``; in a folder of its own if None). Events of a null week are not kept.
    """
    if keep is None:
        spark, made = events.sparkSession, []
        folder = store.folder(spark)

        def keep(df: DataFrame) -> DataFrame:
            made.append(f"{folder}/{len(made)}")
            return store.save(df, made[-1])

    key = F.struct(*by)  # as a struct so that nulls in it match
    weeks = events.filter(F.col("week").isNotNull()).select(*by, "week").distinct().withColumn("entity_", key)
    days = weeks.select(F.col("entity_").alias("entity"), F.col("week").alias("date"), F.lit(0.0).alias("close"))
    jump = keep(asof.lookup(weeks, days, "entity_", F.date_add("week", gap), next="at_or_after").select("entity_", "week", "next"))
    reached = keep(jump.groupBy("entity_").agg(F.min("week").alias("week")))
    jump = jump.filter(F.col("next").isNotNull())
    while True:
        step = keep(reached.join(jump, ["entity_", "week"]).select("entity_", F.col("next").alias("week")))
        if step.isEmpty():
            break
        reached = keep(reached.union(step).distinct())
        onward = jump.select("entity_", F.col("week").alias("next"), F.col("next").alias("after"))
        jump = keep(jump.join(onward, ["entity_", "next"]).select("entity_", "week", F.col("after").alias("next")))
    return events.withColumn("entity_", key).join(reached, ["entity_", "week"], "left_semi").select(*events.columns)


def numbered(events: DataFrame) -> DataFrame:
    """Adds event_id: the place, from 0, in order of entity and week within the definition.

    Counts of entities are summed up first, so that no task sorts all events.
    """
    each = events.groupBy("definition", "entity").agg(F.count(F.lit(1)).alias("__n"))
    before = each.select("definition", "entity", (F.sum("__n").over(Window.partitionBy("definition").orderBy("entity")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("definition", "entity").orderBy("week"))
    return events.withColumn("__place", place).join(before, ["definition", "entity"]).withColumn("event_id", (F.col("__before") + F.col("__place") - 1).cast("long")).drop("__before", "__place")


def common_days(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Entity prices on days on which the market traded too."""
    return prices.join(market.select("date"), "date", "left_semi")


def windows(events: DataFrame, prices: DataFrame, market: DataFrame, calendar: DataFrame, pre: int = PRE, post: int = POST) -> DataFrame:
    """(entity, week, offset, start, end, stock_return, market_return, ar) of raw closes, for each event (entity, week).

    ``calendar`` has the prices of common_days, or their spine. Offsets from 1 count weeks from the anchor (return_start); offset 0 ends on the last day before it and earlier ones
    each end where the next begins, a week before. Rows without bounds or a return are left out.
    """
    days = common_days(prices, market)
    both = days.select("entity", "date", "close").join(market.select("date", F.col("close").alias("mclose")), "date")
    ev = events.select("entity", "week", "return_start").distinct()
    # Each offset ends where the next begins: one lookup of all ends, and the one before from the row before.
    after = ev.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(post))))
    after = asof.snap(after, calendar, "entity", F.expr("date_add(return_start, 7 * offset)"), end="at_or_after")
    after = after.withColumn("start", F.lag("end").over(Window.partitionBy("entity", "week", "return_start").orderBy("offset"))).filter("offset > 0")
    after = after.select("entity", "week", "return_start", "offset", "start", "end")
    chain = asof.snap(ev, calendar, "entity", F.col("return_start"), t0="strictly_before")
    for k in range(pre + 1):
        chain = asof.snap(chain, calendar, "entity", F.date_sub(f"t{k}", 7), **{f"t{k + 1}": "at_or_before"})
    hops = F.array(*[F.struct(F.lit(-k).alias("offset"), F.col(f"t{k + 1}").alias("start"), F.col(f"t{k}").alias("end")) for k in range(pre + 1)])
    before = chain.select("entity", "week", "return_start", F.explode(hops).alias("h")).select("entity", "week", "return_start", "h.*")
    bounds = after.unionByName(before).filter(F.col("end") > F.col("start"))
    a = both.select("entity", F.col("date").alias("start"), F.col("close").alias("p0"), F.col("mclose").alias("m0"))
    b = both.select("entity", F.col("date").alias("end"), F.col("close").alias("p1"), F.col("mclose").alias("m1"))
    rows = bounds.join(a, ["entity", "start"]).join(b, ["entity", "end"])
    rows = rows.withColumn("stock_return", F.col("p1") / F.nullif("p0", F.lit(0.0)) - 1).withColumn("market_return", F.col("m1") / F.nullif("m0", F.lit(0.0)) - 1)
    rows = rows.withColumn("ar", F.col("stock_return") - F.col("market_return")).filter(F.col("ar").isNotNull())
    return rows.select("entity", "week", "offset", "start", "end", "stock_return", "market_return", "ar")


def cumulative(window: DataFrame) -> DataFrame:
    """Adds car (from the first offset) and car_signal (from offset 1 on) of each event of a definition."""
    w = Window.partitionBy("definition", "event_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return window.withColumn("car", F.sum("ar").over(w)).withColumn("car_signal", F.when(F.col("offset") >= 1, F.sum(F.when(F.col("offset") >= 1, F.col("ar"))).over(w)))


def by_offset(window: DataFrame) -> DataFrame:
    """(definition, offset, aar, caar, caar_from_signal, n_events, aar_t)."""
    t = F.when(F.count("ar") > 1, F.avg("ar") / F.nullif(F.stddev_samp("ar") / F.sqrt(F.count("ar")), F.lit(0.0)))
    return cumulative(window).groupBy("definition", "offset").agg(F.avg("ar").alias("aar"), F.avg("car").alias("caar"), F.avg("car_signal").alias("caar_from_signal"), F.count("car").alias("n_events"), t.alias("aar_t"))


def final_car(window: DataFrame) -> DataFrame:
    """(definition, event_id, entity, week, car) of events observed at the last offset that any event of the definition has after the signal."""
    last = window.filter("offset >= 1").groupBy("definition").agg(F.max("offset").alias("__last"))
    reached = cumulative(window).join(F.broadcast(last), "definition").filter(F.col("offset") == F.col("__last"))  # a row for each definition
    return reached.select("definition", "event_id", "entity", "week", F.col("car_signal").alias("car"))
