"""Greedy distance filter by pointer doubling, against the greedy walk."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import events

D = dt.date(2000, 1, 2)


@pytest.mark.parametrize("gap", [1, 28, 100])
def test_like_the_walk(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b", None]), D + dt.timedelta(rng.randrange(900)), k, "x") for k in range(250)] + [("c", D, 1, "x"), ("c", None, 2, "x"), ("a", D, 3, "y"), ("a", D, 4, "y")]
    got = events.non_overlapping(spark.createDataFrame(rows, "entity string, week date, k int, `next` string"), gap)
    want = []
    for e in ("a", "b", "c", None):
        last = None
        for day in sorted({r[1] for r in rows if r[0] == e and r[1]}):
            if last is None or (day - last).days >= gap:
                last = day
                want += [r for r in rows if r[0] == e and r[1] == day]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and got.columns == ["entity", "week", "k", "next"]


def test_no_events(spark):
    assert events.non_overlapping(spark.createDataFrame([], "entity string, week date")).count() == 0


def test_many_events_of_one_entity(spark):
    """100,000 events, every third of which is kept."""
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("entity"), F.expr("date_add(date'1700-01-01', cast(id as int))").alias("week"))
    began = time.time()
    kept = events.non_overlapping(df, 3)
    assert kept.filter("datediff(week, date'1700-01-01') % 3 = 0").count() == kept.count() == (n + 2) // 3
    assert time.time() - began < 240
