"""As-of lookups by tagged union, against bisection; long histories of one entity."""

import bisect
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import asof, features

DAY = dt.date(2020, 1, 1)


def brute(prices, entity, day):
    own = sorted((d, c) for e, d, c in prices if e == entity and d is not None)
    days = [d for d, _ in own]
    if day is None or entity is None:
        return (None,) * 6
    i, j = bisect.bisect_right(days, day), bisect.bisect_left(days, day)
    last = lambda rows: next((c for _, c in reversed(rows) if c is not None), None)
    after = own[j:]
    return (days[i - 1] if i else None, last(own[:i]), days[j - 1] if j else None, last(own[:j]), days[j] if j < len(days) else None, next((c for _, c in after if c is not None), None))


KINDS = ["at_or_before", "price_before", "strictly_before", "price_strictly_before", "at_or_after", "price_after"]


@pytest.mark.parametrize("seed", [1, 2])
def test_lookup(spark, seed):
    rng = random.Random(seed)
    prices = [(e, DAY + dt.timedelta(d), rng.choice([None, float(d)])) for e in ("a", "b", None) for d in sorted(rng.sample(range(200), 60))] + [("a", None, 5.0)]
    targets = [(rng.choice(["a", "b", "c", None]), rng.choice([None, DAY + dt.timedelta(rng.randrange(-20, 230))]), k % 7, "x") for k in range(300)]
    df = spark.createDataFrame(targets + targets[:5], "entity string, target date, `a b` int, close string")
    known = spark.createDataFrame(prices, "entity string, date date, close double")
    got = asof.lookup(df, known, "entity", F.col("target"), **{f"f{k}": kind for k, kind in enumerate(KINDS)})
    assert got.columns == [*df.columns, *[f"f{k}" for k in range(6)]]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = [(e, d, n, x, *brute([p for p in prices if p[0] is not None], e, d)) for e, d, n, x in targets + targets[:5]]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_lookup_of_one_entity(spark):
    prices = [("m", DAY + dt.timedelta(3 * k), float(k)) for k in range(40)]
    rows = [(k, DAY + dt.timedelta(k % 130)) if k % 11 else (k, None) for k in range(400)]
    got = asof.lookup_one(spark.createDataFrame(rows, "k int, target date"), spark.createDataFrame(prices, "entity string, date date, close double"), "m", F.col("target"), b="at_or_before", p="price_after")
    assert sorted((r.k, r.b, r.p) for r in got.collect()) == [(k, *[brute(prices, "m", d)[x] for x in (0, 5)]) for k, d in rows]


def test_lookup_of_timestamps(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    prices = spark.createDataFrame([("a", at(s), float(s)) for s in (1, 5, 9)], "entity string, date timestamp_ntz, close double")
    df = spark.createDataFrame([("a", at(s)) for s in (0, 5, 6)], "entity string, t timestamp_ntz")
    got = asof.lookup(df, prices, "entity", F.col("t"), b="at_or_before", s="strictly_before", a="price_after").orderBy("t").collect()
    assert [(r.b, r.s, r.a) for r in got] == [(None, None, 1.0), (at(5), at(1), 5.0), (at(5), at(5), 9.0)]


def test_lookup_of_nothing(spark):
    none = spark.createDataFrame([], "entity string, date date, close double")
    df = spark.createDataFrame([("a", DAY)], "entity string, d date")
    assert asof.lookup(df, none, "entity", F.col("d"), b="at_or_before").collect() == [("a", DAY, None)]
    assert asof.lookup(df.limit(0), none, "entity", F.col("d"), b="at_or_before").count() == 0


def test_lookup_equals_spine(spark):
    prices = spark.createDataFrame([("a", DAY + dt.timedelta(d), float(d)) for d in (0, 3, 4, 10)], "entity string, date date, close double")
    df = spark.createDataFrame([("a", DAY + dt.timedelta(d)) for d in range(-5, 15)], "entity string, d date")
    columns = dict(b="at_or_before", p="price_before", s="strictly_before", a="at_or_after", q="price_after")
    assert set(asof.snap(df, prices, "entity", F.col("d"), **columns).collect()) == set(asof.snap(df, asof.spine(prices), "entity", F.col("d"), **columns).collect())


def test_long_history_of_one_entity(spark):
    """100,000 prices and as many targets of one entity take seconds: frames only grow."""
    n = 100_000
    prices = spark.range(n).select(F.lit("a").alias("entity"), F.expr("date_add(date'1700-01-01', cast(id as int))").alias("date"), (F.col("id") + 1.0).alias("close"))
    began = time.time()
    found = asof.lookup(prices.select("entity", F.col("date").alias("d"), "close"), prices, "entity", F.col("d"), b="price_before", s="strictly_before", a="price_after")
    assert found.filter("b = close and a = close and (s = date_add(d, -1) or s is null)").count() == n
    assert asof.spine(prices, 5).filter("at_or_before is null or at_or_after is null").count() == 10
    actions = prices.filter("close % 1000 = 0").select("entity", F.col("date").alias("ex_date"), F.lit(100.0).alias("before_price"), F.lit(99.0).alias("after_price"))
    expected = F.col("close") * F.pow(F.lit(0.99), n // 1000 - F.floor(F.col("close") / 1000))
    assert features.adjusted(prices, actions).agg(F.max(F.abs(F.col("adj") / expected - 1))).first()[0] < 1e-9
    assert time.time() - began < 60
