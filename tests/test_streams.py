"""The four queries of one source: killed, restarted, and run on a processing-time trigger."""

import json

import pytest
from pyspark.sql import functions as F

from stationlake.operators import feed
from stationlake.operators.tables import Lake
from stationlake.streaming import feeds, jobs


def status(station, minute, bikes):
    body = {
        "station_id": station, "num_bikes_available": bikes, "num_bikes_disabled": 0, "num_docks_available": 15 - bikes, "num_docks_disabled": 0, "num_ebikes_available": 0, "is_installed": True,
        "is_renting": True, "is_returning": True, "last_reported": 60 * minute, "feed_last_updated": 60 * minute, "feed_version": "2.3", "fetched_at": 60 * minute + 5.5, "snapshot_id": f"s:{60 * minute}",
    }
    return json.dumps(body)


@pytest.fixture
def topic(spark, tmp_path):
    """Three files of twenty minutes each: two stations, a repeat in each file, and one broken message."""
    offset = 0
    for part in range(3):
        rows = []
        for minute in range(1000 + 20 * part, 1000 + 20 * part + 20):
            for station in "ab":
                rows.append((station, status(station, minute, 0 if station == "a" and 1005 <= minute < 1045 else 3), "t", 0, offset, 60 * minute + 6))
                offset += 1
        rows += [(*rows[3][:4], offset, rows[3][5]), ("x", '{"station_id": "', "t", 0, offset + 1, rows[4][5])]
        offset += 2
        spark.createDataFrame(rows, feeds.RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def everything(lake):
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    names = sorted(lake.rows("station_episodes").columns)
    return {n: key(feeds.read(lake, n)) for n in feeds.APPENDS} | {"episodes": key(lake.rows("station_episodes").select(names)), "alerts": key(lake.rows("alerts").select(sorted(lake.rows("alerts").columns)))}


def run(spark, topic, root, **more):
    lake = Lake(spark, f"{root}/lake")
    queries = feeds.start(lambda: feeds.files(spark, topic), lake, f"{root}/checkpoints", F.col("kafka_ts") + 60, **more)
    return lake, queries


def test_four_tables_and_a_query_that_dies(spark, topic, tmp_path, monkeypatch):
    lake, queries = run(spark, topic, tmp_path / "whole")
    feeds.drain(queries)
    want = everything(lake)
    raw = spark.read.schema(feeds.RAW).parquet(topic)
    assert want["bronze"] == sorted(map(tuple, feed.bronze(raw).collect()), key=repr) and len(want["silver"]) == 120
    assert len(want["availability"]) == 2 * 9 and [r[-1] for r in want["episodes"]] and len(want["alerts"]) == 2
    assert len({f"{tmp_path}/whole/checkpoints/{n}" for n in queries}) == 4

    # the second batch of bronze dies after its rows are written and before the ledger is told; silver after the ledger is told
    real, died = Lake._put, []

    def put(self, path, value):
        if "_ledger/bronze" in path and value["batch"] == 1 and "bronze" not in died:
            died.append("bronze")
            raise OSError("killed")
        real(self, path, value)
        if "_ledger/silver" in path and value["batch"] == 1 and "silver" not in died:
            died.append("silver")
            raise OSError("killed")

    monkeypatch.setattr(Lake, "_put", put)
    lake, queries = run(spark, topic, tmp_path / "again")
    with pytest.raises(Exception, match="killed"):
        feeds.drain(queries)
    assert sorted(died) == ["bronze", "silver"]
    assert {n: lake.newest_batch(t, n) for n, (t, _) in feeds.APPENDS.items()} == {"bronze": 0, "silver": 1, "availability": want and lake.newest_batch("availability_5m", "availability")}
    assert len(feeds.read(lake, "bronze").collect()) == 42  # one file's rows, though more are written
    lake, queries = run(spark, topic, tmp_path / "again")
    feeds.drain(queries)
    assert everything(lake) == want


def test_a_stream_without_an_alert(spark, tmp_path):
    """No problem lasts long enough: the table of alerts is there, and empty."""
    rows = [("a", status("a", m, 3 * (m % 2)), "t", 0, m, 60 * m + 6) for m in range(1000, 1020)]
    spark.createDataFrame(rows, feeds.RAW).coalesce(1).write.parquet(str(tmp_path / "in"))
    lake, queries = run(spark, str(tmp_path / "in"), tmp_path, only=("episodes",))
    feeds.drain(queries)
    assert lake.rows("alerts").select("alert_id", "episode_id", "ts").collect() == [] and lake.rows("station_episodes").count() == 10


def test_files_of_state_and_tables_do_not_grow_with_the_shuffle(spark, topic, tmp_path):
    """A session with many shuffle partitions: neither the state nor a day of a batch is cut in as many files, and the session is left as it was."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "60")
    try:
        lake, queries = run(spark, topic, tmp_path, only=("silver", "availability"))
        assert spark.conf.get(name) == "60"
        feeds.drain(queries)
    finally:
        spark.conf.set(name, before)
    for query in queries:
        state = {p.name for p in (tmp_path / "checkpoints" / query / "state" / "0").iterdir() if p.name.isdigit()}
        assert 0 < len(state) <= feeds.STATE_PARTS
    files = [str(p.parent) for p in (tmp_path / "lake" / "silver_status").rglob("part-*")]
    assert max(files.count(p) for p in set(files)) <= feeds.DAY_PARTS
    assert feeds.read(lake, "silver").count() == 120 and feeds.read(lake, "availability").count() == 2 * 9


def test_processing_time_trigger(spark, topic, tmp_path):
    lake, queries = run(spark, topic, tmp_path, every="1 second", only=("bronze", "silver"))
    try:
        for query in queries.values():
            query.processAllAvailable()
            assert query.isActive
    finally:
        for query in queries.values():
            query.stop()
    assert feeds.read(lake, "bronze").count() == 126 and feeds.read(lake, "silver").count() == 120


def test_a_file_is_smaller_than_a_trigger(spark):
    """Files that one task sorts and reads; a trigger takes several, and rows of one time are in one file."""
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 800).alias("snapshot_ts"))
    path, files = jobs.as_files(df, rows_per_file=250, rows_per_trigger=1000)
    read = spark.read.parquet(path).groupBy(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time").alias("age"))
    made = read.agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_ts").alias("a"), F.max("snapshot_ts").alias("b")).orderBy("age").collect()
    assert files == 4 and len(made) >= 12 and max(r.n for r in made) <= 500 and sum(r.n for r in made) == 4000
    assert all(x.b < y.a for x, y in zip(made, made[1:], strict=False))
    assert jobs.as_files(df)[1] == 1
