"""Three outputs of one stateful stream: the latest state of each station, alerts, and episodes.

The stream gives one row type beside the other, each with its payload as JSON. Every micro-batch is kept once and
written three times; each write can be repeated, so that a batch that is delivered again changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stationlake.functions.exprs import Thresholds, episode_id
from stationlake.operators.tables import Lake
from stationlake.streaming.jobs import _episode_rows

PAYLOADS = {
    "state": "station_id string, snapshot_ts bigint, state string, bikes bigint, docks bigint, capacity bigint, open_kind string, open_start_ts bigint",
    "alert": "alert_id string, episode_id string, station_id string, kind string, action string, start_ts bigint, duration_s bigint, ts bigint",
    "episode": "episode_id string, station_id string, kind string, start_ts bigint, end_ts bigint, duration_s bigint, status string, alerted boolean, updated_ts bigint",
}


def outputs(stream: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(row_type, key, ts, payload): the newest row of each station in a trigger with its open episode, alerts, and
    updates of episodes."""

    def advance(key: tuple, frames: Iterator, state: GroupState):
        rows = pd.concat(list(frames)).sort_values(["snapshot_ts", "event_id"], kind="stable")
        before = state.get if state.exists else (None, None, -1, False)
        out, kept = _episode_rows(key[0], rows, before, t.alert_after_s)
        state.update(kept)
        fresh = rows[rows["snapshot_ts"] > before[2]]
        made = [(*x, None, None, None, None) for x in out]
        if not fresh.empty:
            # of several rows of one time the first counts, as everywhere
            top = fresh[fresh["snapshot_ts"] == fresh["snapshot_ts"].max()].iloc[0]
            made.append((key[0], kept[0], "state", kept[1], None, int(top["snapshot_ts"]), kept[3], top["state"], int(top["bikes"]), int(top["docks"]), int(top["capacity"])))
        frame = pd.DataFrame(made, columns=["station_id", "kind", "row_type", "start_ts", "end_ts", "ts", "alerted", "state", "bikes", "docks", "capacity"])
        yield frame.astype(dict.fromkeys(["start_ts", "end_ts", "ts", "bikes", "docks", "capacity"], "Int64"))

    schema = "station_id string, kind string, row_type string, start_ts long, end_ts long, ts long, alerted boolean, state string, bikes long, docks long, capacity long"
    events = stream.groupBy("station_id").applyInPandasWithState(advance, schema, "kind string, start_ts long, last_ts long, alerted boolean", "append", GroupStateTimeout.NoTimeout)
    eid = episode_id(F.col("station_id"), F.col("kind"), F.col("start_ts"))
    aid = F.concat_ws(":", eid, "row_type")
    now = F.struct("station_id", F.col("ts").alias("snapshot_ts"), "state", "bikes", "docks", "capacity", F.col("kind").alias("open_kind"), F.col("start_ts").alias("open_start_ts"))
    alert = F.struct(aid.alias("alert_id"), eid.alias("episode_id"), "station_id", "kind", F.col("row_type").alias("action"), "start_ts", (F.col("ts") - F.col("start_ts")).alias("duration_s"), "ts")
    status = F.when(F.col("end_ts").isNull(), "open").otherwise("closed")
    episode = F.struct(eid.alias("episode_id"), "station_id", "kind", "start_ts", "end_ts", (F.col("ts") - F.col("start_ts")).alias("duration_s"), status.alias("status"), "alerted", F.col("ts").alias("updated_ts"))
    kind = F.when(F.col("row_type").isin("raised", "resolved"), "alert").otherwise(F.col("row_type"))
    body = F.when(kind == "state", F.to_json(now)).when(kind == "alert", F.to_json(alert)).otherwise(F.to_json(episode))
    key = F.when(kind == "state", F.col("station_id")).when(kind == "alert", aid).otherwise(eid)
    return events.select(kind.alias("row_type"), key.alias("key"), "ts", body.alias("payload"))


def split(rows: DataFrame, row_type: str) -> DataFrame:
    """The rows of one type with their payload's fields."""
    return rows.where(F.col("row_type") == row_type).select(F.from_json("payload", PAYLOADS[row_type]).alias("p")).select("p.*")


def newest(rows: DataFrame) -> DataFrame:
    """The newest payload of each key, as a compacted topic holds it."""
    return rows.groupBy("key").agg(F.max_by("payload", "ts").alias("payload"), F.max("ts").alias("ts"))


def write_batch(lake: Lake, rows: DataFrame) -> None:
    """One micro-batch into three tables: latest state and episodes by upsert, alerts by their id."""
    kept = rows.persist()
    try:
        lake.upsert("latest_state", newest(kept.where("row_type = 'state'")), ["key"], "ts")
        lake.upsert("alerts", split(kept, "alert").dropDuplicates(["alert_id"]), ["alert_id"], "ts")
        of = split(kept, "episode")
        last = of.groupBy("episode_id").agg(F.max_by(F.struct(*[c for c in of.columns if c != "episode_id"]), F.struct("updated_ts", F.col("end_ts").isNotNull())).alias("r"))
        lake.upsert("station_episodes", last.select("episode_id", "r.*"), ["episode_id"], "updated_ts")
    finally:
        kept.unpersist()


def run(stream: DataFrame, lake: Lake, checkpoint: str, every: str | None = None, t: Thresholds = Thresholds()):
    """The stream into the three tables: until its source is read, or, with ``every`` (a time), for good."""
    writer = outputs(stream, t).writeStream.foreachBatch(lambda rows, _: write_batch(lake, rows)).option("checkpointLocation", checkpoint).outputMode("append")
    query = writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
    if not every:
        query.awaitTermination()
    return query
