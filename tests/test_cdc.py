import json

import pytest
from pyspark.sql import functions as F

from stationlake.operators import cdc, documents
from stationlake.operators.tables import Lake

COLUMNS = [("dock_id", "int64", None), ("status", "string", None), ("closed_at", "string", "io.debezium.time.ZonedTimestamp"), ("made", "int64", "io.debezium.time.MicroTimestamp")]


def message(op, lsn, after=None, before=None, columns=COLUMNS):
    row = [{"field": n, "type": t} | ({"name": s} if s else {}) for n, t, s in columns]
    schema = {"fields": [{"field": "before", "type": "struct", "fields": row}, {"field": "after", "type": "struct", "fields": row}]}
    return json.dumps({"schema": schema, "payload": {"before": before, "after": after, "op": op, "source": {"lsn": lsn, "ts_ms": 1000 * lsn}}})


def dock(i, status, closed=None, **more):
    return {"dock_id": i, "status": status, "closed_at": closed, "made": 1_000_000} | more


def frame(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, offset long")


def rows(df):
    return sorted((r.dock_id, r.status) for r in df.collect())


def test_decode_types_tombstones_and_errors(spark):
    got = cdc.decode(frame(spark, message("c", 1, dock(1, "ok", "2026-01-01T10:20:00.12+02:00")), None, message("d", 2, None, dock(1, "ok")))).orderBy("lsn").collect()
    assert len(got) == 2 and str(got[0].closed_at) == "2026-01-01 08:20:00.120000" and got[0].made.second == 1 and got[1].dock_id == 1 and got[1].op == "d"
    with pytest.raises(ValueError):
        cdc.decode(frame(spark, message("x", 1, dock(1, "ok"))))
    with pytest.raises(TypeError):
        cdc.decode(frame(spark, message("c", 1, dock(1, "ok"), columns=[*COLUMNS, ("odd", "int64", "some.other.Type")])))
    with pytest.raises(TypeError):
        cdc.decode(frame(spark, message("c", 1, dock(1, "ok")), message("c", 2, dock(2, "ok"), columns=[("dock_id", "string", None)])))


@pytest.mark.parametrize("bad", [message("d", 2), message("c", 3), message("u", 4, before=dock(1, "x")), json.dumps({"payload": {"op": "c", "after": {}, "source": {"lsn": 1}}})])
def test_an_event_without_its_image_or_schema_is_refused(spark, bad):
    with pytest.raises(ValueError, match="1 messages without"):
        cdc.decode(frame(spark, message("c", 1, dock(1, "ok")), bad))


@pytest.mark.parametrize("text", ["2024-01-15", "2024-01-15T10:00:00", "15-01-2024T10:00:00Z", "2024-01-15T10:00:00+0200", "soon-0800"])
def test_a_time_without_a_zone_is_refused(spark, text):
    with pytest.raises(Exception, match="not a zoned timestamp"):
        cdc.decode(frame(spark, message("c", 1, dock(1, "ok", text)))).collect()


def test_nine_digits_of_a_second_and_offsets(spark):
    made = spark.createDataFrame([("2024-01-15T10:00:00.123456789Z",), ("2024-01-15T10:00:00.5-08:00",), ("2024-01-15T10:00Z",)], "t string")
    got = [str(r[0]) for r in made.select(cdc.zoned(made.t)).collect()]
    assert got == ["2024-01-15 10:00:00.123456", "2024-01-15 18:00:00.500000", "2024-01-15 10:00:00"]


def test_types_are_kept_between_batches(spark, tmp_path):
    """A column that arrives in a later batch is null before; one that changes its type there is refused, and nothing is written."""
    lake = Lake(spark, str(tmp_path / "lake"))
    send = lambda *values: cdc.apply_all(lake, spark.createDataFrame([("o.p.docks", key("dock_id", dock_id=1), v, i) for i, v in enumerate(values)], "topic string, key string, value string, offset long"))
    wide = [*COLUMNS, ("priority", "int32", None)]
    send(message("c", 1, dock(1, "ok")))
    send(message("c", 2, dock(2, "ok", priority=7), columns=wide))
    assert {r.dock_id: r.priority for r in lake.rows("docks").collect()} == {1: None, 2: 7}
    with pytest.raises(TypeError, match="priority"):
        send(message("u", 3, dock(1, "gone", priority="high"), columns=[*COLUMNS, ("priority", "string", None)]))
    with pytest.raises(TypeError, match="made"):
        send(message("u", 3, dock(1, "gone"), columns=[*COLUMNS[:3], ("made", "int64", None)]))
    assert rows(lake.rows("docks")) == [(1, "ok"), (2, "ok")]
    send(message("u", 4, dock(1, "back")))
    assert rows(lake.rows("docks")) == [(1, "back"), (2, "ok")]


def test_apply_evolves_and_replays(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = frame(spark, message("c", 1, dock(1, "ok")), message("c", 2, dock(2, "ok")), message("u", 3, dock(1, "out")))
    wide = [*COLUMNS, ("priority", "int32", None)]
    second = frame(spark, message("d", 5, None, dock(2, "ok")), message("u", 2, dock(1, "stale")), message("c", 6, dock(3, "ok", priority=2), columns=wide))
    cdc.apply(lake, "docks", cdc.decode(first), ["dock_id"])
    for _ in range(2):
        cdc.apply(lake, "docks", cdc.decode(second), ["dock_id"])
        assert rows(lake.rows("docks")) == [(1, "out"), (3, "ok")]
    assert {r.dock_id: r.priority for r in lake.rows("docks").collect()} == {1: None, 3: 2}


def key(*fields, **values):
    return json.dumps({"schema": {"fields": [{"field": f} for f in fields]}, "payload": values})


def test_stream_of_many_tables(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    van = [("plate", "string", None), ("status", "string", None)]
    batches = [
        [("ops.public.docks", key("dock_id", dock_id=1), message("c", 1, dock(1, "ok"))), ("ops.public.docks", key("dock_id", dock_id=2), message("c", 2, dock(2, "ok"))), ("ops.public.vans", key("plate", plate="X"), message("c", 3, {"plate": "X", "status": "idle"}, columns=van))],
        [("ops.public.docks", key("dock_id", dock_id=1), message("d", 4, None, dock(1, "ok"))), ("ops.public.docks", key("dock_id", dock_id=1), None)],
    ]
    for i, values in enumerate(batches):
        made = spark.createDataFrame([(*v, 10 * i + k) for k, v in enumerate(values)], "topic string, key string, value string, offset long")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        cdc.replicate(cdc.source(spark, str(tmp_path / "in")), lake, str(tmp_path / "checkpoint"))
    assert rows(lake.rows("docks")) == [(2, "ok")] and lake.rows("vans").select("plate", "status").first() == ("X", "idle")
    cdc.reset(lake, ["docks", "vans"], str(tmp_path / "checkpoint"))
    assert lake.existing(["docks", "vans"]) == [] and not (tmp_path / "checkpoint").exists()
    cdc.replicate(cdc.source(spark, str(tmp_path / "in"), 9), lake, str(tmp_path / "checkpoint"))
    assert rows(lake.rows("docks")) == [(2, "ok")]


def test_messages_are_judged_in_one_pass_for_all_tables(spark):
    """However many tables there are; and a message without a key is judged like the others."""
    made = lambda *tables: spark.createDataFrame([(f"o.p.{t}", key("dock_id", dock_id=1), message("c", 1, dock(1, "ok")), 1) for t in tables], "topic string, key string, value string, offset long")

    def passes(df):
        spark.sparkContext.setJobGroup(group := f"judged {len(df.collect())}", "")
        found = cdc.decoded(df)
        return list(found), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (one, n), (three, m) = passes(made("a")), passes(made("a", "b", "c"))
    assert one == ["a"] and three == ["a", "b", "c"] and n == m <= 2
    bad = made("a").unionByName(made("a").withColumns({"key": F.lit(None).cast("string"), "value": F.lit(message("x", 2, dock(1, "ok")))}))
    with pytest.raises(ValueError, match="unknown operation"):
        cdc.decoded(bad)


def test_keys_of_several_columns(spark):
    made = spark.createDataFrame([("a.b.t", key("x", "y", x=1, y=2), "{}", 1), ("a.b.u", key("z", z=1), "{}", 1)], "topic string, key string, value string, offset long")
    assert cdc.keys(made) == {"t": ["x", "y"], "u": ["z"]}


def test_export_is_conditional_and_bounded(spark, tmp_path):
    page = documents.document(spark.createDataFrame([(1, "a")], "n int, s string"), ["n", "s"], ["n"], {})
    made = documents.export(spark, str(tmp_path), {"live": page}, 100, 111)
    assert json.loads((tmp_path / "live.json").read_text())["rows"] == [["1", "a"]] and made["generated_at"] == 111
    assert documents.export(spark, str(tmp_path), {"live": page}, 100, 222) == made
    assert documents.export(spark, str(tmp_path), {"live": page}, 101, 222)["generated_at"] == 222
    with pytest.raises(ValueError):
        documents.export(spark, str(tmp_path), {"live": page}, 102, 333, most_bytes=5)
