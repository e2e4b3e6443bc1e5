"""Snapshots, archive, trips: rules on hand-made rows, odd files and refusals."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from stationlake.operators import feed, snapshots, trips


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def station(i, bikes=1, docks=2, reported=5, **more):
    return {"station_id": i, "num_bikes_available": bikes, "num_docks_available": docks, "is_installed": 1, "is_renting": 0, "is_returning": 1, "last_reported": reported} | more


def test_archive_explode_and_rejects(spark, tmp_path):
    base = tmp_path / "station_status"
    files = {
        "dt=2026-01-01/10/100.json.gz": {"last_updated": 100, "version": "2.3", "data": {"stations": [station("a"), station("b", bikes=-1), station(None), station("c", reported=None)]}},
        "dt=2026-01-02/00/200.json.gz": {"last_updated": 200, "version": "2.3", "data": {}},
        "dt=2026-01-03/00/300.json.gz": {"last_updated": 300, "version": "2.3", "data": {"stations": [station("a", extra=9)]}},
    }
    for name, doc in files.items():
        (base / name).parent.mkdir(parents=True)
        (base / name).write_bytes(gzip.compress(json.dumps(doc).encode()))
    every = snapshots.read_archive(spark, str(tmp_path), "station_status")
    assert rows(every.select("last_updated", "path_epoch", "dt")) == [(100, 100, "2026-01-01"), (200, 200, "2026-01-02"), (300, 300, "2026-01-03")]
    some = snapshots.read_archive(spark, str(tmp_path), "station_status", ["2026-01-01", "2026-01-02"]).withColumn("fetched_at", F.lit(7.12345))
    assert rows(snapshots.messages(some).select("key", "is_installed", "is_renting", "fetched_at", "snapshot_id")) == [("a", True, False, 7.123, "station_status:100")]
    assert rows(snapshots.rejects(some).select("key", "errors")) == [
        ("b", "num_bikes_available negative"), ("c", "last_reported missing"), ("station_status:100", "station_id missing"), ("station_status:200", "stations missing"),
    ]
    assert rows(snapshots.counts(some)) == [("station_status:100", 1, 3), ("station_status:200", 0, 1)]


def test_flags_are_required_and_a_replay_is_of_one_day(spark, tmp_path):
    base = tmp_path / "station_status" / "dt=1970-01-03" / "00"
    base.mkdir(parents=True)
    for t, more in ((172_800, {}), (172_860, {"is_returning": None}), (172_920, {"is_renting": None, "is_installed": None}), (259_200, {})):
        (base / f"{t}.json.gz").write_bytes(gzip.compress(json.dumps({"last_updated": t, "version": "2.3", "data": {"stations": [station("a"), station("b", **more)]}}).encode()))
    every = snapshots.read_archive(spark, str(tmp_path), "station_status").withColumn("fetched_at", F.lit(7.0))
    assert rows(snapshots.rejects(every).select("key", "errors")) == [("b", "is_installed missing; is_renting missing"), ("b", "is_returning missing")]
    sent = snapshots.messages(every)
    places = lambda **k: rows(snapshots.replayed(sent, 2, **k).select("key", "place"))
    assert places() == [("a", 1), ("a", 2), ("a", 3), ("b", 1)] and places(skip=1, limit=1) == [("a", 2)]
    for bad in ({"skip": 3}, {"skip": -1}, {"limit": 0}):
        with pytest.raises(ValueError):
            snapshots.replayed(sent, 2, **bad)
    with pytest.raises(ValueError):
        snapshots.replayed(sent, 5)


def test_repeats_and_unchanged_content_in_any_order(spark):
    schema = "feed string, last_updated long, fetched_at double, stations array<struct<station_id: string, n: int>>"
    made = spark.createDataFrame([("f", 1, 1.0, [("a", 1), ("b", 2)]), ("f", 1, 2.0, [("a", 1), ("b", 2)]), ("f", 2, 3.0, [("b", 2), ("a", 1)]), ("f", 3, 4.0, [("a", 2)])], schema)
    assert rows(snapshots.published(made).select("fetched_at", "repeated", "unchanged")) == [(1.0, False, False), (2.0, True, False), (3.0, False, True), (4.0, False, False)]


def test_pacific_days_have_their_hours(spark):
    days = spark.createDataFrame([("2026-03-08",), ("2026-11-01",), ("2026-01-01",)], "d string").select(F.to_date("d").alias("d"))
    start, end = snapshots.day_bounds(F.col("d"))
    assert rows(days.select(F.col("d").cast("string"), ((end - start) / 3600).cast("int"))) == [("2026-01-01", 24), ("2026-03-08", 23), ("2026-11-01", 25)]


def test_complete_day(spark):
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "d string").select(F.to_date("d").alias("day"))
    pick = lambda df, today: str(snapshots.complete_day(df, today).first()[0])
    assert pick(days("2026-01-01", "2026-01-02", "2026-01-03"), "2026-01-03") == "2026-01-02"
    assert pick(days("2026-01-03"), "2026-01-03") == "2026-01-03" and pick(days("2026-01-04"), "2026-01-03") == "None"


def test_bronze_keeps_broken_text_and_silver_drops_it(spark):
    good = json.dumps({"station_id": "a", "num_bikes_available": 0, "num_docks_available": 3, "is_installed": True, "is_renting": True, "last_reported": 90, "feed_last_updated": 100, "fetched_at": 101.5, "odd": 1})
    closed = json.dumps({"station_id": "b", "num_bikes_available": 5, "num_docks_available": 3, "num_docks_disabled": 2, "is_installed": False, "is_renting": True, "last_reported": 90, "feed_last_updated": 100})
    raw = spark.createDataFrame([("a", good, "t", 0, 1, 7), ("b", closed, "t", 0, 2, 7), ("c", "{oops", "t", 0, 3, 7), ("d", None, "t", 0, 4, 7)], "key string, value string, topic string, partition int, offset long, timestamp long")
    bronze = feed.bronze(raw)
    assert bronze.columns[-2:] == ["num_scooters_available", "num_scooters_unavailable"] and bronze.count() == 4
    assert bronze.where("kafka_offset = 3").first().raw_json == "{oops"
    assert rows(feed.silver(bronze, F.lit(9)).select("station_id", "capacity", "state", "processed_ts")) == [("a", 3, "empty", 9), ("b", 10, "offline", 9)]


LEGACY = ",".join(trips.LAYOUTS["legacy"])


def test_csv_with_mark_quotes_breaks_and_blank_lines(spark, tmp_path):
    lines = [
        LEGACY + ",bike_share_for_all_trip", '75,2019-01-31 17:57:44.6130,2019-01-31 17:58:59,  12 ,"Market St, at ""10th""",37.7,-122.4,,"Two\nlines",x,,99,Subscriber,No', "",
        "n/a,2018-11-04 01:30:00,2019-03-10 02:30:00,,,,,7,,1e1,2,,Other,No", "5,later,2019-01-01 00:00:00,1,a,1,1,1,a,1,1,1,Customer,No",
    ]
    path = tmp_path / "m.csv"
    path.write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode())
    read = trips.read_csv(spark, str(path))
    got = trips.mapped(read).select("start_station_code", "start_station_name", "end_station_name", "started_at", "ended_at", "duration_s", "start_lat", "end_lat", "member_type", "bike_id").collect()
    assert len(got) == 3
    assert tuple(got[0]) == ("12", 'Market St, at "10th"', "Two\nlines", 1548986264, 1548986339, 75, 37.7, None, "member", "99")
    # the first of two clock times; a time that the clock skipped is as before the gap
    assert tuple(got[1]) == (None, None, None, 1541320200, 1552213800, None, None, 10.0, None, None)
    assert got[2].started_at is None and got[2].member_type == "casual"


@pytest.mark.parametrize(
    "header", [[], ["Trip Id"], ["ride_id", "ride_id", *trips.LAYOUTS["ride"][1:]], trips.LAYOUTS["ride"][1:], ["a;drop"], [*trips.LAYOUTS["legacy"][1:], "extra"]]
)
def test_refused_headers(header):
    with pytest.raises(trips.TripError):
        trips.layout_of(header)


def test_layouts_by_header():
    assert trips.layout_of(reversed(trips.LAYOUTS["ride"])) == "ride" and trips.layout_of([*trips.LAYOUTS["legacy"], "tail_1"]) == "legacy"


def test_load_replaces_good_months_only(spark, tmp_path):
    schema = "trip_month date, schema_version string, started_at long, ended_at long"
    made = lambda *r: spark.createDataFrame(r, "m string, v string, a long, b long").select(F.to_date("m").alias("trip_month"), F.col("v").alias("schema_version"), F.col("a").alias("started_at"), F.col("b").alias("ended_at"))
    path = str(tmp_path / "trips")
    trips.load(made(("2026-01-01", "ride", 1, 2), ("2026-02-01", "ride", 1, 2)), path)
    audit = trips.load(made(("2026-01-01", "ride", 5, 6), ("2026-01-01", "ride", 7, 8), ("2026-02-01", "ride", None, 2)), path)
    assert rows(audit.select(F.month("trip_month"), "csv_rows", "bad_timestamps", "status", "loaded_rows")) == [(1, 2, 0, "ok", 2), (2, 1, 1, "error", None)]
    assert rows(spark.read.parquet(path).select("started_at")) == [(1,), (5,), (7,)] and "trip_month" in schema


def test_months(spark):
    df = spark.createDataFrame([("2026-01",), ("2026-13",), ("26-01",), (None,)], "m string")
    assert rows(df.select(trips.month_start(F.col("m")).cast("string"))) == [("2026-01-01",), (None,), (None,), (None,)]
    names = spark.createDataFrame([("202601-city-tripdata.csv.zip",), ("202601-city-tripdata.zip",), ("202602-x-tripdata.zip",), ("202613-x-tripdata.zip",), ("index.html",)], "name string")
    assert rows(trips.month_files(names).select(F.col("trip_month").cast("string"), "files", "ambiguous")) == [("2026-01-01", 2, True), ("2026-02-01", 1, False)]
