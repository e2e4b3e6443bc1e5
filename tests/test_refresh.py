"""Refreshed marts, the sliding window of minutes, nested documents, texts, and tables in the catalog."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stationlake.functions.exprs import double_text
from stationlake.operators import availability, catalogue, documents, episodes, gate, health, marts, refresh
from stationlake.operators.tables import Lake
from stationlake.session import JobConfig

T0 = 1_704_096_000  # 2024-01-01 08:00 UTC, midnight in the Pacific zone
STATUS = "event_id long, station_id string, snapshot_ts long, state string, bikes long, docks long, capacity long, kafka_ts long, processed_ts long, fetched_ts long"


def status(spark, rows):
    return spark.createDataFrame([(i, s, t, state, b, 15 - b, 15, t + 3, t + 60, t + 5) for i, (s, t, state, b) in enumerate(rows)], STATUS)


def plain(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_refreshed_marts_are_those_of_all_rows(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), T0 + 60 * rnd.randrange(5 * 1440), rnd.choice(["ok", "empty", "full", "offline"]), rnd.randrange(16)) for _ in range(900)]
    stations = spark.createDataFrame([(x, f"S{x}", "1") for x in "ab"], "station_id string, station_name string, region_id string")
    lake = Lake(spark, str(tmp_path))
    late = [r for r in rows if r[1] >= T0 + 3 * 86400 or (r[1] < T0 + 86400 and r[3] == 7)]
    early = [r for r in rows if r not in late]
    assert len(refresh.arrive(lake, status(spark, early), stations)[0]) == 3
    days, read = refresh.arrive(lake, status(spark, late), stations)
    assert [str(d) for d in days] == ["2024-01-01", "2024-01-04", "2024-01-05"]
    assert read == sum(r[1] < T0 + 86400 or r[1] >= T0 + 3 * 86400 for r in rows) < len(rows)
    staged = availability.staged(availability.windows(status(spark, rows)))
    assert plain(lake.read(refresh.DAILY)) == plain(marts.daily(staged, stations))
    assert sum(r.live_days for r in refresh.profile(lake).collect()) == staged.select("station_id", "hour_of_day", "service_date").distinct().count()
    # a date whose rows are gone leaves the mart
    lake.replace_where(refresh.SILVER, lake.read(refresh.SILVER).limit(0), F.col("service_date") == days[0], ("service_date",))
    assert refresh.recompute(lake, days[:1], stations) == 0 and lake.read(refresh.DAILY).where(F.col("service_date") == days[0]).count() == 0
    assert refresh.arrive(lake, status(spark, rows).limit(0), stations) == ([], 0)


def test_minutes_slide_and_repeat(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = [("a", T0 + 60 * m, "ok", 5) for m in range(0, 3000, 7)]
    every = status(spark, rows)
    for upto in (T0 + 60 * 2900, T0 + 60 * 2960, T0 + 60 * 2960):
        health.write_minutes(lake, every.where(F.col("processed_ts") <= upto))
    table = lake.read("pipeline_minutely").drop("day")
    assert table.count() == 1440 + 56 == table.select("minute").distinct().count()  # rows come every 7 minutes, so the ends of both windows are 56 apart
    assert plain(table.where(F.col("minute") >= F.lit(T0 + 60 * 2960 - 1439 * 60 - 420))) and plain(table.orderBy(F.desc("minute")).limit(1440)) == plain(health.series(every.where(F.col("processed_ts") <= T0 + 60 * 2960)))
    health.write_minutes(lake, every.limit(0))
    assert lake.read("pipeline_minutely").count() == 1496


def test_nested_document_and_its_budget(spark):
    one = spark.createDataFrame([(1, "x")], "n int, s string")
    many = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k int, v string")
    text = documents.nested({"one": one}, {"many": (many, ["k"]), "none": (many.limit(0), ["k"])}, {"format": 2}, 1000).first()
    assert json.loads(text.document) == {"format": 2, "one": {"n": 1, "s": "x"}, "many": [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}, {"k": 3}], "none": []}
    with pytest.raises(Exception, match="more than 20"):
        documents.nested({"one": one}, {"many": (many, ["k"])}, {}, 20).collect()


def test_components_without_anything_to_measure(spark):
    runs = spark.createDataFrame([], "run_id string, table_name string, status string, finished_at long")
    none = spark.createDataFrame([], "passed boolean, rules_passed long, rules_failed long, problems string")
    got = {r.name: (r.status, r.detail) for r in health.components(status(spark, []), none, runs, T0).collect()}
    assert got == {"stream": ("fail", ""), "quality": ("warn", ""), "maintenance": ("warn", ""), "overall": ("fail", "")}


def test_lake_check_fails_what_it_can_not_see(spark):
    bronze = spark.createDataFrame([], "station_id string, snapshot_ts long, partition int, offset long")
    commits = spark.createDataFrame([("bronze", 90.0, "replace"), ("silver", 50.0, "append")], "table_name string, committed_at double, operation string")
    got = {r.check: r.passed for r in gate.lake_check(bronze, bronze, commits, 100).collect()}
    assert got == {"silver repeats": True, "offsets repeated": False, "offsets missing": False, "partitions": False, "silver behind": False, "commit age bronze": False, "commit age silver": True}


def test_texts_of_both_actions(spark):
    alerts = spark.createDataFrame([("1", "a", "empty", "raised", T0, 930), ("2", "a", "empty", "resolved", T0, 3630), ("3", "z", "full", "raised", T0 + 46_800, 900)], "alert_id string, station_id string, kind string, action string, start_ts long, duration_s long")
    names = spark.createDataFrame([("a", "N" * 120)], "station_id string, station_name string")
    got = {r.alert_id: r for r in episodes.alert_texts(alerts, names).collect()}
    assert len(got["1"].subject) == 100 and got["1"].body.startswith("Since 12:00 AM Pacific there are no bikes at NN") and got["1"].body.endswith(": 16 min up to now.")
    assert got["2"].body == f"What began at 12:00 AM Pacific at {'N' * 120} is over after 60 min." and got["3"].subject == "z: no free docks for 15 min" and "1:00 PM" in got["3"].body


def test_shortest_text_of_doubles(spark):
    rnd = random.Random(8)
    values = [0.0, -0.0, 1e-5, 1e-4, 1e15, 1e16, -1e16, 1e22, 0.1 + 0.2, 100.0, 5e-310, 1.7976931348623157e308, float("nan"), float("inf"), float("-inf"), 9999999999999998.0]
    values += [rnd.random() * 10 ** rnd.randint(-12, 15) for _ in range(2000)] + [round(rnd.uniform(-1000, 1000), rnd.randint(0, 9)) for _ in range(2000)] + [rnd.randrange(10**9) / 7 for _ in range(1000)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(double_text(F.col("x"))).collect()]
    assert got == [repr(v) for v in values]


def test_tables_are_created_once_in_the_catalog(spark, tmp_path):
    config = JobConfig(prefix="lab1_", checkpoints="lab", status_topic="l.s", alerts_topic="l.a", state_topic="l.t").validate()
    made = catalogue.create(spark, str(tmp_path), config)
    assert "lab1_silver.trips" in made and len(made) == 5 and catalogue.create(spark, str(tmp_path), config) == []
    trips = spark.createDataFrame([("2024-01", "N1", 60, 5, "member", "N2", "more")], "month string, start_code string, duration_s long, started long, rider string, end_code string, other string")
    catalogue.append(trips, "silver.trips", config)
    assert catalogue.create(spark, str(tmp_path), config) == [] and {r.table_name: (r.n, r.parts) for r in catalogue.layout(spark, config).collect()}["silver.trips"] == (1, 1)
    spark.sql("DROP TABLE lab1_metrics.maintenance_runs")
    spark.sql("CREATE TABLE lab1_metrics.maintenance_runs (run_id INT) USING parquet")
    with pytest.raises(TypeError):
        catalogue.create(spark, str(tmp_path), config)
