"""Collection state: entries, upserts, reset on a changed request, and every reason not to read a file."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import asof, collection, governance

ASKED = {"timeframe": "today 5-y", "geo": "TW", "availability_policy": "start+14d"}
FIELDS = [c.strip().split(" ")[0] for c in collection.ENTRY.split(",")]


def made(spark, names, at=1, request=ASKED, **instead):
    sha = governance.request_hash(request)
    rows = [{"entity": n, "scale_factor": 1.0, "batch": 0, **{k: request[k] for k in collection.REQUEST}, "request_sha256": sha, "n_rows": 3, "file_sha256": f"sha-{n}", "collected_at": at, "error": "", **instead} for n in names]
    return spark.createDataFrame([[r.get(f) for f in FIELDS] for r in rows], collection.ENTRY)


def header(spark, *requests, version=collection.VERSION):
    return spark.createDataFrame([(version, governance.request_hash(r)) for r in requests], "version int, request_sha256 string")


def found(spark, *names):
    return spark.createDataFrame([(n, f"sha-{n}") for n in names], "entity string, file_sha256 string")


def test_success_and_error_entries(spark):
    weeks = spark.createDataFrame([("a", dt.date(2024, 1, 7) + dt.timedelta(7 * k), 1.0) for k in range(3)], "entity string, start date, svi double")
    files = spark.createDataFrame([("a", "x", None)], "entity string, file_sha256 string, raw_file_sha256 string")
    got = collection.success_entries(asof.annotate(weeks), files, spark.createDataFrame([("a", 4, 0.5)], "entity string, batch int, scale_factor double"), ASKED, 7).collect()
    assert [(r.entity, r.scale_factor, r.batch, r.date_start, r.date_end, r.available_at_end, r.n_rows, r.file_sha256, r.availability_policy, r.collected_at, r.error) for r in got] == [
        ("a", 0.5, 4, dt.date(2024, 1, 7), dt.date(2024, 1, 27), dt.date(2024, 2, 4), 3, "x", "start+14d", 7, "")
    ]
    bad = collection.error_entries(spark.createDataFrame([("b", 4, "too many requests")], "entity string, batch int, error string"), ASKED, 8).first()
    assert bad.scale_factor is None and bad.n_rows == 0 and bad.file_sha256 is None and bad.error == "too many requests" and bad.geo == "TW"
    with pytest.raises(ValueError, match="availability_policy"):
        collection.error_entries(spark.createDataFrame([("b", 4, "x")], "entity string, batch int, error string"), {"timeframe": "t", "geo": "g"}, 1)


def test_upsert_keeps_the_latest(spark):
    state = made(spark, "ab", at=1)
    new = made(spark, "b", at=2, scale_factor=None, error="lost").unionByName(made(spark, "bc", at=3)).unionByName(made(spark, "a", at=0, scale_factor=9.0)).unionByName(made(spark, "c", at=3, scale_factor=None, error="e", file_sha256="zzz"))
    assert {(r.entity, r.collected_at, r.scale_factor, r.error) for r in collection.upsert(state, new).collect()} == {("a", 1, 1.0, ""), ("b", 3, 1.0, ""), ("c", 3, 1.0, "")}


@pytest.mark.parametrize("change", ["timeframe", "geo", "availability_policy"])
def test_a_changed_request_starts_afresh(spark, tmp_path, change):
    store, other = collection.Store(spark, str(tmp_path / "state")), {**ASKED, change: "other"}
    assert store.entries(ASKED).count() == 0 and store.header().count() == 0
    assert store.add(made(spark, "ab"), ASKED) == 1
    assert store.add(made(spark, "c", at=2), ASKED) == 2
    assert {r.entity for r in store.entries(ASKED).collect()} == {"a", "b", "c"} and store.entries(other).count() == 0
    store.add(made(spark, "d", at=3, request=other), other)
    assert {r.entity for r in store.entries().collect()} == {"d"} and store.entries(ASKED).count() == 0


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    store = collection.Store(spark, str(tmp_path / "state"))
    store.add(made(spark, "a"), ASKED)
    made(spark, "xyz").write.parquet(str(tmp_path / "state" / "v=2" / "entries"))
    assert {r.entity for r in store.entries(ASKED).collect()} == {"a"}
    assert store.add(made(spark, "b", at=2), ASKED) == 2 and store.entries(ASKED).count() == 2


def test_every_error(spark):
    other = {**ASKED, "availability_policy": "start+7d"}
    state = made(spark, ["good", "gone"]).unionByName(made(spark, ["failed"], scale_factor=None, error="timeout")).unionByName(made(spark, ["silent"], scale_factor=None, error=""))
    state = state.unionByName(made(spark, ["policy"], availability_policy="start+7d")).unionByName(made(spark, ["frame"], timeframe="now 7-d", geo=None)).unionByName(made(spark, ["request"], request_sha256="x"))
    state = state.unionByName(made(spark, ["changed"], file_sha256="y")).unionByName(made(spark, ["unhashed"], file_sha256=None))
    files = found(spark, "good", "failed", "silent", "policy", "frame", "request", "changed", "unhashed", "stranger")
    got = {r.entity: r.error for r in collection.errors(files, state, header(spark, ASKED), ASKED).collect()}
    assert got == {
        "good": None, "gone": "no file", "failed": "failed: timeout", "silent": "failed: no successful collection recorded", "policy": "stale/incompatible: availability_policy",
        "frame": "stale/incompatible: timeframe, geo", "request": "stale/incompatible: request_sha256", "changed": "file hash mismatch", "unhashed": "file hash mismatch", "stranger": "no entry",
    }
    assert {r.error for r in collection.errors(files, state, header(spark), ASKED).collect()} == {"no manifest"}
    for head in (header(spark, other), header(spark, ASKED, version=1)):
        assert {r.error for r in collection.errors(files, state, head, ASKED).collect()} == {"manifest of another request"}
    collection.assert_readable(found(spark, "good"), made(spark, ["good"]), header(spark, ASKED), ASKED)
    with pytest.raises(ValueError, match="changed: file hash mismatch"):
        collection.assert_readable(found(spark, "changed"), made(spark, ["changed"], file_sha256="y"), header(spark, ASKED), ASKED)
