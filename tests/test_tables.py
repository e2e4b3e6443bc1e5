import json

import pytest
from pyspark.sql import functions as F

from stationlake.operators import lineage
from stationlake.operators.tables import Lake


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_evolves_and_refuses(spark, lake):
    assert not lake.exists("t") and lake.existing(["t"]) == []
    lake.append("t", spark.createDataFrame([(1,)], "id long"))
    lake.append("t", spark.createDataFrame([(2, 5)], "id long, priority int"))
    assert rows(lake.read("t").select("id", "priority")) == [(1, None), (2, 5)] and lake.existing(["t", "u"]) == ["t"]
    with pytest.raises(TypeError):
        lake.append("t", spark.createDataFrame([("x",)], "id string"))
    lake.drop("t")
    assert not lake.exists("t")


def test_replaced_partitions_and_refused_ones(spark, lake):
    month = "month string, n int"
    lake.append("m", spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], month), ("month",))
    assert lake.replace_partitions("m", spark.createDataFrame([("2026-02", 7), ("2026-02", 8)], month), ("month",), F.col("n") > 0) == 2
    assert rows(lake.read("m").select("n")) == [(1,), (7,), (8,)]
    with pytest.raises(ValueError):
        lake.replace_partitions("m", spark.createDataFrame([("2026-01", -1)], month), ("month",), F.col("n") > 0)
    assert rows(lake.read("m").select("n")) == [(1,), (7,), (8,)]


def test_replace_a_window_across_partitions(spark, lake):
    schema = "day int, minute long, n int"
    lake.append("p", spark.createDataFrame([(0, 10, 1), (0, 90, 2), (1, 110, 3), (2, 210, 4)], schema), ("day",))
    lake.replace_where("p", spark.createDataFrame([(0, 95, 9)], schema), (F.col("minute") >= 90) & (F.col("minute") < 200), ("day",))
    assert rows(lake.read("p").select("minute", "n")) == [(10, 1), (210, 4), (95, 9)]


def test_upsert_and_replays(spark, lake):
    e = "id string, updated long, status string"
    lake.upsert("e", spark.createDataFrame([("a", 5, "open"), ("b", 5, "open")], e), ["id"], "updated")
    for _ in range(2):
        lake.upsert("e", spark.createDataFrame([("a", 5, "closed"), ("b", 4, "stale"), ("c", 1, "open")], e), ["id"], "updated")
    assert rows(lake.rows("e").select("id", "updated", "status")) == [("a", 5, "closed"), ("b", 5, "open"), ("c", 1, "open")]


def test_upsert_without_rows_leaves_a_table_that_can_be_read(spark, lake):
    e = "id string, updated long, status string"
    for _ in range(2):
        lake.upsert("none", spark.createDataFrame([], e), ["id"], "updated")
    assert lake.rows("none").select("id", "updated", "status").collect() == [] and not lake.exists("none")
    lake.upsert("none", spark.createDataFrame([("a", 5, "open")], e), ["id"], "updated")
    assert rows(lake.rows("none").select("id", "updated", "status")) == [("a", 5, "open")]


def test_compaction_keeps_rows_and_records_its_run(spark, lake):
    lake.append("s", spark.range(1000).withColumn("station", F.col("id") % 7).repartition(8))
    lake.append("d", spark.range(60).withColumn("day", (F.col("id") % 3).cast("int")).repartition(6), ("day",))
    report = lake.compact("s", ["station", "id"]).first()
    assert report.files_before == 8 and report.files_after == 1 and report.rows_after == 1000 and lake.read("s").distinct().count() == 1000
    one = lake.compact("d", ["id"], ("day",), F.col("day") == 1).first()
    assert one.files_before > one.files_after == 1 and lake.read("d").count() == 60
    run = lake.maintain({"d": (["id"], ("day",)), "gone": (["id"], ()), "s": (["id"], ())}, "r1", 5, 9)
    assert [(r.table_name, r.status, r.rows_after) for r in run.orderBy("table_name").collect()] == [("d", "ok", 60), ("gone", "skipped", None), ("s", "ok", 1000)]
    assert lake.read("maintenance_runs").count() == 3 and len(run.columns) == 18
    assert {r.partition for r in lake.files("d").collect()} == {"day=0", "day=1", "day=2"}


def test_compaction_deals_rows_to_tasks(spark, lake, monkeypatch):
    """Many rows in few bytes are sorted by several tasks, within one partition as well; order and rows stay."""
    from stationlake.operators import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 250)
    of = spark.range(1000).withColumn("day", F.when(F.col("id") < 900, 1).otherwise(2))
    lake.append("x", of.drop("day"))
    lake.append("y", of, ("day",))
    lake.compact("x", ["id"])
    lake.compact("y", ["id"], ("day",))
    for name in "xy":
        n = [r.n for r in lake.files(name).collect()]
        assert sum(n) == 1000 == lake.read(name).distinct().count() and len(n) >= 4 and max(n) < 500


def test_every_write_is_a_commit(spark, lake):
    day = "day int, n int"
    lake.append("c", spark.createDataFrame([(1, 1), (1, 2), (2, 3)], day).repartition(1), ("day",))
    lake.append("c", spark.createDataFrame([(3, 4)], day).repartition(1), ("day",))
    lake.replace_partitions("c", spark.createDataFrame([(2, 5), (2, 6)], day).repartition(1), ("day",))
    lake.compact("c", ["n"], ("day",))
    lake.append("c", spark.createDataFrame([], day), ("day",))
    got = [(r.operation, r.files, r.rows, r.partitions) for r in lake.commits("c").orderBy("committed_at").collect()]
    assert got == [("append", 2, 3, 2), ("append", 1, 1, 1), ("overwrite", 1, 2, 1), ("replace", 3, 5, 3), ("append", 0, 0, 0)]
    assert rows(lake.partitions("c").select("partition", "files", "commits")) == [("day=1", 1, 1), ("day=2", 1, 1), ("day=3", 1, 1)]
    assert lake.commits("none").count() == 0 and rows(lake.commits().select("table_name").distinct()) == [("c",)]


def test_a_batch_is_written_once(spark, lake, monkeypatch):
    """Killed before the ledger is told, and after: the rows are there once either way, and half a batch is never read."""
    made = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    assert lake.append_once("b", made(1, 2), "q", 0) and not lake.append_once("b", made(1, 2), "q", 0)
    real = Lake._put
    monkeypatch.setattr(Lake, "_put", lambda self, path, value: (_ for _ in ()).throw(OSError("killed")) if "_ledger" in path else real(self, path, value))
    with pytest.raises(OSError):
        lake.append_once("b", made(3, 4), "q", 1)
    assert rows(lake.committed("b", "q")) == [(1,), (2,)] and lake.read("b").count() == 4
    monkeypatch.setattr(Lake, "_put", real)
    assert lake.append_once("b", made(3), "q", 1) and rows(lake.committed("b", "q")) == [(1,), (2,), (3,)]
    lake.fold("b", "q")
    assert rows(lake.committed("b", "q")) == [(1,), (2,), (3,)] and lake.partitions("b").count() == 1
    assert not lake.append_once("b", made(3), "q", 1) and lake.append_once("b", made(9), "q", 2) and lake.committed("b", "q").count() == 4


@pytest.mark.parametrize("dies_at", ["write", "delete"])
def test_a_dead_writer_is_finished_by_the_next(spark, lake, monkeypatch, dies_at):
    """Killed while partitions are swapped, or before emptied ones are deleted: the next writer repeats both steps."""
    schema = "day int, n int"
    lake.append("w", spark.createDataFrame([(1, 1), (2, 2), (3, 3)], schema), ("day",))

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        if dies_at == "write":
            m.setattr(Lake, "_write", die)
        else:
            real = Lake._delete
            m.setattr(Lake, "_delete", lambda self, path: die() if "day=2" in path else real(self, path))
        with pytest.raises(OSError):
            lake.replace_where("w", spark.createDataFrame([(1, 8)], schema), F.col("n") <= 2, ("day",))
    assert lake.recover("w") and not lake.recover("w")
    assert rows(lake.read("w").select("day", "n")) == [(1, 8), (3, 3)] and lake.orphans("w") == 0


def test_a_check_that_fails_and_an_input_that_changes(spark, lake):
    """Rows are staged once: what is checked is what is written, even if computing it twice gave other rows."""
    odd = spark.range(1000).select(F.lit("m").alias("month"), F.rand().alias("x"))
    assert lake.replace_partitions("r", odd, ("month",), F.col("x") < 1) == 1000
    with pytest.raises(ValueError):
        lake.replace_partitions("r", odd, ("month",), F.col("x") < 0.5)
    assert lake.read("r").count() == 1000 and lake.orphans("r") == 0


def test_buckets_double_with_the_table(spark, lake, monkeypatch):
    from stationlake.operators import tables

    monkeypatch.setattr(tables, "MOST_ROWS", 40)
    for i in range(4):
        lake.upsert("g", spark.range(400 * i, 400 * i + 400).select("id", F.lit(i).alias("at")), ["id"], "at")
    assert lake.rows("g").count() == 1600 == lake.rows("g").select("id").distinct().count()
    assert lake.partitions("g").count() > 16
    lake.upsert("g", spark.createDataFrame([(7, 99)], "id long, at int"), ["id"], "at")
    assert lake.rows("g").where("id = 7").select("at").first()[0] == 99 and lake.rows("g").count() == 1600


def test_created_once_and_read_by_name(spark, lake):
    assert lake.create("n", "day int, n long", ("day",)) and not lake.create("n", "day int, n long", ("day",))
    assert lake.read("n").count() == 0 and lake.read("n").columns == ["day", "n"]
    lake.append("n", spark.createDataFrame([(1, 2)], "day int, n long"), ("day",))
    with pytest.raises(TypeError):
        lake.append("n", spark.createDataFrame([(1, "x")], "day int, n string"), ("day",))
    assert lake.read("n").count() == 1


def test_lineage_by_instant(spark, tmp_path):
    def event(at, run, inputs, outputs):
        return {"eventTime": at, "eventType": "COMPLETE", "job": {"namespace": "n", "name": "j"}, "run": {"runId": run}, "inputs": inputs, "outputs": outputs}

    named = {"namespace": "s3", "name": "x/raw", "facets": {"symlinks": {"identifiers": [{"namespace": "c", "name": "db.raw", "type": "TABLE"}]}}}
    lines = [
        event("2026-01-01T10:00:00+02:00", "old", [{"name": "gone"}], [{"name": "out"}]), event("2026-01-01T09:30:00Z", "new", [named], [{"name": "out"}]),
        event("2026-01-02T00:00:00Z", "half", [named], []),
    ]
    (tmp_path / "e.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    assert rows(lineage.edges(lineage.read(spark, str(tmp_path / "e.jsonl")))) == [("j", "reads", "db.raw"), ("j", "writes", "out")]
