import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import asof, events, features, panel

D = dt.date


def days(start, n, step=1):
    return [start + dt.timedelta(days=i * step) for i in range(n)]


def calendar(spark, dates, close=None):
    return asof.spine(spark.createDataFrame([("a", d, float(c)) for d, c in zip(dates, close or range(100, 100 + len(dates)))], "entity string, date date, close double"))


def look(spark, spine, target):
    df = spark.createDataFrame([("a", target)], "entity string, d date")
    return asof.snap(df, spine, "entity", F.col("d"), b="at_or_before", s="strictly_before", a="at_or_after").first()


def test_annotation_crosses_the_year(spark):
    df = spark.createDataFrame([("a", D(2021, 12, 26), 10.0), ("a", D(2022, 1, 2), 20.0)], "entity string, start date, svi double")
    rows = asof.annotate(df).orderBy("start").collect()
    assert [r.period_end for r in rows] == [D(2022, 1, 1), D(2022, 1, 8)]
    assert [r.available_at for r in rows] == [D(2022, 1, 9), D(2022, 1, 16)]
    assert asof.annotate(asof.annotate(df)).count() == 2


def test_a_week_must_start_on_sunday(spark):
    df = spark.createDataFrame([("a", D(2022, 1, 3), 10.0)], "entity string, start date, svi double")
    with pytest.raises(Exception, match="not a week start"):
        asof.annotate(df).collect()


def test_snaps(spark):
    sp = calendar(spark, [D(2022, 1, 7), D(2022, 1, 11), D(2022, 1, 12)])
    r = look(spark, sp, D(2022, 1, 9))
    assert (r.a, r.b, r.s) == (D(2022, 1, 11), D(2022, 1, 7), D(2022, 1, 7))
    r = look(spark, sp, D(2022, 1, 11))
    assert (r.a, r.b, r.s) == (D(2022, 1, 11), D(2022, 1, 11), D(2022, 1, 7))
    r = look(spark, sp, D(2030, 1, 1))
    assert (r.a, r.b, r.s) == (None, None, None)


def test_forward_return_without_a_horizon_is_null(spark):
    sp = calendar(spark, [D(2022, 1, 11), D(2022, 1, 12)])
    df = spark.createDataFrame([("a", D(2022, 1, 11), 1)], "entity string, d date, n int")
    r = asof.forward_return(df, sp, "entity", "d", "n", "r", "e").first()
    assert (r.r, r.e) == (None, None)


def test_trailing_and_skip_returns(spark):
    dates = days(D(2022, 1, 3), 60)
    sp = calendar(spark, dates)
    df = spark.createDataFrame([("a", D(2022, 2, 20), 1)], "entity string, d date, n int")
    r = asof.trailing_return(df, sp, "entity", "d", "n", "r").first().r
    i = dates.index(D(2022, 2, 20))
    assert r == pytest.approx((100 + i) / (100 + i - 7) - 1)
    r = asof.skip_return(df, sp, "entity", "d", 4, 2, "r").first().r
    assert r == pytest.approx((100 + i - 14) / (100 + i - 28) - 1)


GOOD = dict(start=D(2022, 1, 2), period_end=D(2022, 1, 8), available_at=D(2022, 1, 16), signal_date=D(2022, 1, 16), first_tradeable_at=D(2022, 1, 17), feature_date=D(2022, 1, 14), return_start=D(2022, 1, 17), z_window_end=D(2022, 1, 8), return_end_1w=D(2022, 1, 24))
SCHEMA = ", ".join(f"{k} date" for k in GOOD)


def contract(spark, **change):
    return spark.createDataFrame([tuple((GOOD | change).values())], SCHEMA)


def test_contract(spark):
    assert asof.assert_contract(contract(spark)).count() == 1
    broken = contract(spark, feature_date=D(2022, 1, 7), first_tradeable_at=D(2022, 1, 10), return_start=D(2022, 1, 10), return_end_1w=D(2022, 1, 17))
    found = {r.rule for r in asof.count_violations(broken).collect() if r.n}
    assert found == {"r05_traded_before_signal"}
    with pytest.raises(Exception, match="r05"):
        asof.assert_contract(broken).collect()
    with pytest.raises(ValueError):
        asof.count_violations(contract(spark).drop("signal_date"))


@pytest.mark.parametrize("field,rules", [("start", {"r01_start_not_sunday", "r02_period_end"}), ("signal_date", set())])
def test_null_dates_break_only_the_first_rules(spark, field, rules):
    assert {r.rule for r in asof.count_violations(contract(spark, **{field: None})).collect() if r.n} == rules


def test_attention_sees_no_later_week(spark):
    weeks = days(D(2021, 1, 3), 70, 7)
    def z(values):
        df = spark.createDataFrame([("a", w, float(v)) for w, v in zip(weeks, values)], "entity string, start date, svi double")
        return features.attention(df).orderBy("start").collect()
    a, b = z(range(70)), z([*range(60), *[1000] * 10])
    assert a[40].z == b[40].z and a[24].ma52 is None and a[25].ma52 is not None


def adjusted(spark, closes, actions):
    p = spark.createDataFrame([("a", d, c) for d, c in closes], "entity string, date date, close double")
    e = spark.createDataFrame([("a", *x) for x in actions], "entity string, ex_date date, before_price double, after_price double")
    return [r.adj for r in features.adjusted(p, e).orderBy("date").collect()]


def test_price_adjustment(spark):
    closes = [(D(2022, 7, 13), 23.45), (D(2022, 7, 14), 22.2), (D(2022, 7, 15), 23.0)]
    assert adjusted(spark, closes, []) == [23.45, 22.2, 23.0]
    assert adjusted(spark, closes, [(D(2022, 7, 14), 23.45, 22.2)]) == pytest.approx([23.45 * 22.2 / 23.45, 22.2, 23.0])
    assert adjusted(spark, closes, [(D(2022, 7, 14), 0.0, 22.2)]) == [23.45, 22.2, 23.0]
    flat = [(D(2021, 1, 1), 100.0), (D(2022, 8, 1), 100.0), (D(2023, 8, 1), 100.0)]
    f1, f2 = 100 / 110, 95 / 105
    assert adjusted(spark, flat, [(D(2022, 6, 1), 110.0, 100.0), (D(2023, 6, 1), 105.0, 95.0)]) == pytest.approx([100 * f1 * f2, 100 * f2, 100])


def test_average_rank(spark):
    df = spark.createDataFrame([(1, x) for x in (5.0, 3.0, 3.0, None)], "week int, x double")
    got = df.select("x", panel.average_rank("x", ["week"]).alias("r")).collect()
    assert sorted((r.r for r in got if r.r is not None)) == [1, 2.5, 2.5] and any(r.x is None and r.r is None for r in got)


def test_events_keep_their_distance(spark):
    weeks = [D(2024, 1, 1), D(2024, 1, 15), D(2024, 1, 29), D(2024, 2, 25)]
    df = spark.createDataFrame([("a", w) for w in weeks], "entity string, week date")
    assert sorted(r.week for r in events.non_overlapping(df).collect()) == [D(2024, 1, 1), D(2024, 1, 29)]


def test_event_windows_join_up(spark):
    business = [d for d in days(D(2021, 11, 1), 140) if d.weekday() < 5]
    p = spark.createDataFrame([("a", d, 100.0 + i) for i, d in enumerate(business)], "entity string, date date, close double")
    m = spark.createDataFrame([("M", d, 200.0 + i) for i, d in enumerate(business)], "entity string, date date, close double")
    ev = spark.createDataFrame([("a", D(2022, 1, 9), D(2022, 1, 10))], "entity string, week date, return_start date")
    got = {r.offset: r for r in events.windows(ev, p, m, asof.spine(p)).collect()}
    assert (got[1].start, got[1].end) == (D(2022, 1, 10), D(2022, 1, 17))
    assert all(got[k].end == got[k + 1].start for k in range(-4, 0)) and got[0].end == D(2022, 1, 7)
    i = business.index(D(2022, 1, 10))
    assert got[1].ar == pytest.approx((105 + i) / (100 + i) - (205 + i) / (200 + i))
