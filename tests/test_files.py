import datetime as dt

import pytest

from strandline.sources import files

D = dt.date


def put(path, text):
    path.write_text(text, encoding="utf-8-sig")
    return str(path)


def test_universe_keeps_leading_zeros(spark, tmp_path):
    path = put(tmp_path / "list.csv", "stock_id,stock_name,keyword,industry,note\n0050,a,b,c,\n")
    assert files.read_universe(spark, path).first().stock_id == "0050"
    with pytest.raises(FileNotFoundError):
        files.read_universe(spark, str(tmp_path / "none.csv"))


def test_prices_keep_the_last_row_of_a_day(spark, tmp_path):
    path = put(tmp_path / "price_0050.csv", "date,close,Trading_Volume,Trading_money\n2022-01-03,1,10,10\n2022-01-03,2,20,40\n2022-01-04,3,30,90\n")
    got = files.read_prices(spark, path).orderBy("date").collect()
    assert [(r.entity, r.close, r.volume) for r in got] == [("0050", 2.0, 20.0), ("0050", 3.0, 30.0)]
    with pytest.raises(ValueError, match="close"):
        files.read_prices(spark, put(tmp_path / "price_1.csv", "date\n2022-01-03\n"))


@pytest.mark.parametrize("text", ["date,SVI\n2022-01-02,10\n", "date,keyword a,isPartial\n2022-01-02,10,False\n2022-01-09,3,True\n", "observation_period_start,observation_period_end,SVI\n2022-01-02,2022-01-08,10\n"])
def test_three_layouts_of_interest(spark, tmp_path, text):
    got = files.read_interest(spark, put(tmp_path / "trends_2330.csv", text)).collect()
    assert [(r.entity, r.start, r.svi) for r in got] == [("2330", D(2022, 1, 2), 10.0)]


def test_actions_may_be_absent(spark, tmp_path):
    assert files.read_actions(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "dividend_1.csv").write_text("")
    assert files.read_actions(spark, str(tmp_path / "dividend_1.csv")).count() == 0
    path = put(tmp_path / "dividend_2.csv", "date,before_price,after_price\n2022-07-14,23.45,22.2\n2022-07-15,,1\n")
    assert [(r.entity, r.ex_date) for r in files.read_actions(spark, path).collect()] == [("2", D(2022, 7, 14))]


def test_two_layouts_of_flows(spark, tmp_path):
    a = files.read_flows(spark, put(tmp_path / "flow_1.csv", "date,name,buy,sell\n2022-01-03,x,100,40\n")).first()
    b = files.read_flows(spark, put(tmp_path / "flow_2.csv", "date,institutional_net_shares\n2022-01-03,60\n")).first()
    assert (a.buy - a.sell, b.total_net, b.entity) == (60, 60, "2")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "entity string, x double")
    files.write_table(df, str(tmp_path / "t"), csv=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "t_csv")).columns == ["entity", "x"]
    files.write_series(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "entity=a").is_dir()
    m = spark.createDataFrame([("a", "p", 1.0, "t", "g", "r", "f", None)], "entity string, path string, scale_factor double, timeframe string, geo string, request_sha256 string, file_sha256 string, error string")
    files.write_manifest(m, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).collect() == m.collect()


def test_panel_is_asserted_when_read(spark, tmp_path):
    d = dt.date(2022, 1, 2)
    row = (d, d + dt.timedelta(6), d + dt.timedelta(14), d + dt.timedelta(14), d + dt.timedelta(15), d + dt.timedelta(14), d + dt.timedelta(15))
    kind = "start date, period_end date, available_at date, signal_date date, first_tradeable_at date, feature_date date, return_start date"
    good, bad = files.safe_name(f"{tmp_path}/good/"), f"{tmp_path}/bad"
    assert good.endswith("good_asof_safe") and files.safe_name(good) == good
    spark.createDataFrame([row], kind).write.parquet(good)
    spark.createDataFrame([(*row[:5], row[6], row[6])], kind).write.parquet(bad)
    assert files.read_panel(spark, good).count() == 1
    with pytest.raises(Exception, match="look-ahead"):
        files.read_panel(spark, bad).collect()
