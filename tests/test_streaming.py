import datetime as dt

from strandline.streaming.activity import activity, write_activity


def test_stream_and_table_agree(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=7 * i), "ab"[i % 2], float(i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    write_activity(stream, str(tmp_path / "out"), str(tmp_path / "ck"), late="10 days").awaitTermination()
    closed = {(r.start, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.start, r.event_type): (r.n, r.total) for r in activity(spark.read.parquet(str(tmp_path / "in"))).collect()}
    # Windows up to the watermark, ten days behind the last event, are closed; no other is.
    end = max(r[0] for r in rows) - dt.timedelta(days=10)
    assert closed == {k: v for k, v in whole.items() if k[0] + dt.timedelta(days=1) <= end} and len(whole) > len(closed) > 0
