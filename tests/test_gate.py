"""Gate, sessions, documents and sinks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from stationlake.operators import documents, gate, health
from stationlake.operators.tables import Lake
from stationlake.plans import reports
from stationlake.session import JobConfig, ask
from stationlake.streaming import jobs, sinks

STATUS = "event_id long, station_id string, snapshot_ts long, state string, bikes long, docks long, capacity long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def status(spark, *r):
    return spark.createDataFrame(r, "station_id string, snapshot_ts long, state string, bikes int, docks int, capacity int, processed_ts long")


def test_each_rule_can_fail(spark):
    good = ("a", 100_000, "ok", 5, 5, 12, 100_010)
    bad = {
        "station_not_null": (None, 100_000, "ok", 5, 5, 12, 100_010), "state_domain": ("b", 100_000, "odd", 5, 5, 12, 100_010), "bikes_not_negative": ("b", 100_000, "ok", -1, 5, 12, 100_010),
        "docks_not_negative": ("b", 100_000, "ok", 5, -1, 12, 100_010), "within_capacity": ("b", 100_000, "ok", 9, 9, 12, 100_010), "unique": good,
    }
    names = ["station_id", "state"]
    assert {r.status for r in gate.results(gate.measured(status(spark, good), names, 100_200)).collect()} == {"ok"}
    for rule, row in bad.items():
        found = {r.rule: r for r in gate.results(gate.measured(status(spark, good, row), names, 100_200)).collect()}
        assert [n for n, r in found.items() if r.status != "ok"] == [rule] and found[rule].unexpected >= 1
    late = {r.rule: r.status for r in gate.results(gate.measured(status(spark, good), [*names, "gone"], 200_000)).collect()}
    assert late["fresh"] == "warn" and late["column_set"] == "fail"
    empty = {r.rule: r.status for r in gate.results(gate.measured(status(spark, good).limit(0), names, 1)).collect()}
    assert empty["row_count"] == "fail" and empty["fresh"] == "warn"


def test_verdict_needs_all_results_of_this_run(spark):
    good = gate.results(gate.measured(status(spark, ("a", 100, "ok", 5, 5, 12, 110)), ["state"], 120))
    none = spark.createDataFrame([], "problem string")
    tests = spark.createDataFrame([("t", 0)], "name string, n long")
    verdict = lambda e, t=tests, p=none: gate.verdict(p, t, e, "now").first()
    mine = good.withColumn("run", F.lit("now"))
    assert verdict(mine).passed
    assert not verdict(mine.where("rule != 'unique'")).passed and not verdict(good.withColumn("run", F.lit("old"))).passed
    assert verdict(mine, tests.withColumn("n", F.lit(2))).problems == "test t: 2" and not verdict(mine, p=spark.createDataFrame([("x",)], "problem string")).passed


def test_pairs_of_batches_and_commits(spark):
    b = spark.createDataFrame([("t", 0, 5), ("t", 10, 5), ("t", 20, 7), ("t", 30, 5)], "table_name string, batch_ts long, n long")
    commits = lambda *c: spark.createDataFrame([("t", *x) for x in c], "table_name string, commit_ts long, n long")
    pairs = lambda *c: {r.batch_ts: r.commit_ts for r in health.pair_batches(b, commits(*c)).collect()}
    assert pairs((5, 5), (15, 5), (25, 7), (35, 5)) == {0: 5, 10: 15, 20: 25, 30: 35}
    assert pairs((12, 5), (13, 5), (25, 7)) == {0: 12, 10: 13, 20: 25, 30: None}
    assert pairs((0, 5), (10, 5), (5000, 7)) == {0: 10, 10: None, 20: None, 30: None}
    assert pairs((22, 7), (40, 5)) == {0: 40, 10: None, 20: None, 30: None}


def test_lab_runs_keep_away_from_production():
    lab = {"checkpoints": "lab", "status_topic": "l.s", "alerts_topic": "l.a", "state_topic": "l.t"}
    assert JobConfig().validate() and JobConfig(prefix="lab_", **lab).validate().table("silver.status") == "lab_silver.status"
    for bad in (JobConfig(starting_offsets="latest"), JobConfig(prefix="Lab", **lab), JobConfig(prefix="lab_", **{**lab, "alerts_topic": "gbfs.alerts"})):
        with pytest.raises(ValueError):
            bad.validate()


def test_ask(spark):
    df = spark.range(100)
    assert ask(spark, "SELECT id FROM numbers WHERE id > 10", {"numbers": df}).count() == 50


def test_words_and_orders(spark):
    df = spark.createDataFrame([("a", "Pier 10", 30), ("b", "pier 2", 100), ("c", None, 7500)], "station_id string, name string, s long")
    assert [r.station_id for r in documents.sorted_list(df, "name").orderBy("place").collect()] == ["b", "a", "c"]
    assert [r.station_id for r in documents.sorted_list(df, "name", True).orderBy("place").collect()] == ["a", "b", "c"]
    assert rows(df.select(documents.duration_text(F.col("s")))) == [("1 min",), ("2 h 5 min",), ("30 s",)]
    hours = spark.createDataFrame([(0,), (11,), (12,), (23,)], "h int")
    assert [r[0] for r in hours.orderBy("h").select(documents.hour_label(F.col("h"))).collect()] == ["12 AM–1 AM", "11 AM–12 PM", "12 PM–1 PM", "11 PM–12 AM"]
    with pytest.raises(Exception, match="not constant"):
        documents.header(df, ["name"]).collect()


def test_state_machine_over_triggers_and_redelivery(spark, tmp_path):
    lake, source = Lake(spark, str(tmp_path / "lake")), str(tmp_path / "in")
    batches = [
        [(1, "a", 0, "empty"), (2, "a", 600, "empty"), (3, "b", 0, "ok")],
        [(4, "a", 900, "empty"), (5, "a", 600, "ok"), (6, "a", 1200, "full"), (7, "b", 60, "full")],
        [(8, "a", 1260, "offline"), (9, "b", 120, "full")],
    ]
    for batch in batches:
        spark.createDataFrame([(*r, 1, 2, 3) for r in batch], STATUS).coalesce(1).write.mode("append").parquet(source)
    for name in ("c1", "c2"):  # the second delivers all again
        sinks.run(jobs.source(spark, source), lake, str(tmp_path / name))
        assert rows(lake.rows("alerts").select("alert_id", "ts")) == [("a:empty:0:raised", 900), ("a:empty:0:resolved", 1200)]
        assert rows(lake.rows("station_episodes").select("episode_id", "end_ts", "status", "alerted")) == [("a:empty:0", 1200, "closed", True), ("a:full:1200", 1260, "closed", False), ("b:full:60", None, "open", False)]
    state = lake.rows("latest_state").withColumn("p", F.from_json("payload", sinks.PAYLOADS["state"]))
    assert rows(state.select("p.station_id", "p.snapshot_ts", "p.state", "p.open_kind", "p.open_start_ts")) == [("a", 1260, "offline", None, None), ("b", 120, "full", "full", 60)]


def test_health_document_maps_trips_and_status_once(spark, monkeypatch):
    """What has two places in the document is made once: its plan reads no table but jobs, and trips are mapped once."""
    mapped, real = [], reports.src.trips
    monkeypatch.setattr(reports.src, "trips", lambda s, d: mapped.append(d) or real(s, d))
    made = reports._health_document(spark, "/root/testdata/sf0.001")
    assert len(mapped) == 1 and not [f for f in made.inputFiles() if "/events.parquet" in f or "/lineitem.parquet" in f]
    assert made.where("section = 'minute'").count() == 1440
