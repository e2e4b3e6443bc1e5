"""Hand-worked cases of the station rules, merges, trips and series."""

import datetime as dt

from pyspark.sql import functions as F

from stationlake.functions import exprs
from stationlake.operators import cdc, documents, episodes, fleet, health


def states(spark, rows):
    df = spark.createDataFrame(rows, "bikes long, docks long, size long, working boolean, age long")
    return [r[0] for r in df.select(exprs.station_state(F.col("bikes"), F.col("docks"), F.col("size"), F.col("working"), F.col("age"))).collect()]


def test_first_rule_wins(spark):
    rows = [(0, 0, 9, True, 1801), (0, 5, 9, False, 0), (0, 9, 9, True, 0), (9, 0, 9, True, 0), (2, 9, 11, True, 0), (3, 30, 33, True, 0), (8, 1, 9, True, 0), (8, 8, 16, True, 1800)]
    assert states(spark, rows) == ["offline", "offline", "empty", "full", "low", "low", "high", "ok"]


def status(spark, rows):
    return spark.createDataFrame([(i, "s", t, state, 1, 1, 2) for i, (t, state) in enumerate(rows)], "event_id long, station_id string, snapshot_ts long, state string, bikes int, docks int, capacity int")


def test_episodes_open_close_and_switch(spark):
    rows = [(180, "low"), (60, "empty"), (0, "ok"), (120, "empty"), (240, "empty"), (300, "full")]
    got = sorted((r.kind, r.start_ts, r.end_ts, r.duration_s, r.status) for r in episodes.episodes(status(spark, rows)).collect())
    assert got == [("empty", 60, 180, 120, "closed"), ("empty", 240, 300, 60, "closed"), ("full", 300, None, 0, "open")]


def test_alert_is_raised_once_and_resolved(spark):
    rows = [(60 * m, "full") for m in range(20)] + [(1260, "ok")]
    got = sorted((r.action, r.duration_s) for r in episodes.alerts(status(spark, rows)).collect())
    assert got == [("raised", 900), ("resolved", 1260)]


def test_merge_guards_and_replay(spark):
    schema = "order_id long, line int, lsn long, offset long, op string, quantity long, status string"
    first = spark.createDataFrame([(1, 1, 10, 1, "c", 5, "a"), (2, 1, 11, 1, "c", 6, "a"), (2, 1, 12, 1, "u", 7, "b")], schema)
    second = spark.createDataFrame([(1, 1, 9, 2, "u", 99, "stale"), (2, 1, 13, 2, "d", 7, "b"), (3, 1, 14, 2, "r", 1, "n")], schema)
    once = cdc.merge(cdc.merge(cdc.empty(first), first), second)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(once) == [(1, 1, 5, "a", 10), (3, 1, 1, "n", 14)]
    assert rows(cdc.merge(once, second)) == rows(once)


def test_local_times(spark):
    rows = [("2026-03-08 02:30:00",), ("2025-11-02 01:30:00",), ("2026-01-15 12:00:00",), ("soon",), ("",), ("2026-02-30 00:00:00",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(exprs.local_epoch(F.try_to_timestamp("t").cast("timestamp_ntz"))).collect()]
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())
    assert got == [utc(2026, 3, 8, 10, 30), utc(2025, 11, 2, 8, 30), utc(2026, 1, 15, 20), None, None, None]


def test_pairs_take_the_first_unused_commit(spark):
    batches = spark.createDataFrame([("t", 100, 647), ("t", 160, 647), ("t", 220, 1294), ("t", 280, 500)], "table_name string, batch_ts long, n long")
    commits = spark.createDataFrame([("t", 90, 647), ("t", 110, 647), ("t", 120, None), ("t", 170, 647), ("t", 230, 1294), ("t", 290, 499)], "table_name string, commit_ts long, n long")
    got = sorted((r.batch_ts, r.commit_ts) for r in health.pair_batches(batches, commits).collect())
    assert got == [(100, 110), (160, 170), (220, 230), (280, None)]


def test_month_status(spark):
    trips = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 3, 1),)], "trip_month date")
    got = [(r.trip_month.month, r.status) for r in fleet.month_status(trips).orderBy("trip_month").collect()]
    assert got == [(1, "published"), (2, "missing"), (3, "published"), (4, "pending")]


def test_replay_decodes_what_was_encoded(spark):
    rows = [(0, "ok"), (3600, "ok"), (7200, "empty"), (10800, "ok"), (10860, "full")]
    moved = documents.deltas(status(spark, rows))
    seen = {k: documents.decode(moved, k).first()["state"] for k in range(4)}
    assert seen == {0: "ok", 1: "ok", 2: "empty", 3: "full"} and moved.count() == 3


def test_document(spark):
    df = spark.createDataFrame([(2, "b"), (1, 'a"')], "n int, s string")
    row = documents.document(df, ["n", "s"], ["n"], {"v": "1"}).first()
    import json

    assert json.loads(row.document) == {"v": "1", "columns": ["n", "s"], "rows": [["1", 'a"'], ["2", "b"]]}
    assert row.bytes == len(row.document.encode())
