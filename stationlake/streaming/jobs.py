"""Structured Streaming jobs over status rows: availability windows, episodes with state, and the sinks' rules.

The sources are file streams of rows in time order, or a Kafka topic where the connector is there. Each
output has a checkpoint of its own; ``drain`` runs a query over all that is there and then ends."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stationlake.functions.exprs import PROBLEMS, Thresholds
from stationlake.operators.availability import SHARES, measures, shares

STATUS = "event_id long, station_id string, snapshot_ts long, state string, bikes long, docks long, capacity long"
EVENT = "kind string, row_type string, start_ts long, end_ts long, ts long, alerted boolean"


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"


def as_files(df: DataFrame, order: tuple[str, ...] = ("snapshot_ts", "event_id"), rows_per_file: int = 250_000, rows_per_trigger: int = 1_000_000, parts: int = 4) -> tuple[str, int]:
    """df written as files in order of time, ``parts`` or more, each of about ``rows_per_file`` rows at most; the folder's path,
    and how many a trigger is to read: those of about ``rows_per_trigger`` rows, so that what a trigger holds does not grow with the history.

    A file is what one task sorts, and what one task of a trigger reads. One pass writes them, dealt by ranges of the first column of
    ``order``, so that rows of one time are in one file; a stream reads files by their age, so they get theirs by range."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    rows = df.count()
    n, triggers = (max(parts, -(-rows // most)) for most in (rows_per_file, rows_per_trigger))
    df.repartitionByRange(n, order[0]).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    made = sorted((s.getPath() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))), key=lambda f: f.getName())
    first = int(time.time()) - len(made)
    for i, file in enumerate(made):
        fs.setTimes(file, 1000 * (first + i), -1)
    return path, max(1, n // triggers)


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(STATUS).option("maxFilesPerTrigger", files).parquet(path)


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The topic's messages; at most 100,000 in a trigger."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", 100_000).load()


def distinct_rows(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each station and snapshot, as long as repeats come within the watermark."""
    timed = stream.withColumn("time", F.timestamp_seconds("snapshot_ts")).withWatermark("time", late)
    return timed.dropDuplicatesWithinWatermark(["station_id", "time"])


def availability(stream: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Windows that are final: the watermark has passed their end. The same columns as ``availability.windows`` gives in batch."""
    w = F.window("time", size)
    grouped = distinct_rows(stream).groupBy(w.alias("w"), "station_id").agg(*measures(), *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in SHARES)).withColumns(shares())
    start, end = F.unix_timestamp("w.start").alias("window_start"), F.unix_timestamp("w.end").alias("window_end")
    return grouped.select(start, end, "station_id", "samples", "min_bikes", "avg_bikes", "max_bikes", "avg_docks", "capacity", *(f"share_{s}" for s in SHARES))


def _episode_rows(station: str, rows: pd.DataFrame, kept: tuple, after_s: int) -> tuple[list[tuple], tuple]:
    """What a station's rows of one trigger (snapshot_ts, state; in order of time) say of its episodes, and what is
    to be kept: (kind, start, newest time, alerted) of the open one.

    The rows are cut into runs of one kind; a kept episode goes before them as a run of its own, or is carried on by the first."""
    kind, start, newest, alerted = kept
    new = rows[rows["snapshot_ts"] > newest].drop_duplicates("snapshot_ts")
    if new.empty:
        return [], kept
    ts, kinds = new["snapshot_ts"].to_numpy(), new["state"].where(new["state"].isin(PROBLEMS), "").to_numpy(str)
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(ts)]
    pieces = [(kinds[i], int(ts[i]), ts[i:j], False) for i, j in zip(cuts, cuts[1:], strict=False)]
    if kind is not None:
        carried = pieces.pop(0)[2] if pieces[0][0] == kind else ts[:0]
        pieces.insert(0, (kind, start, carried, alerted))
    out: list[tuple] = []
    for k, (of, begin, times, known) in enumerate(pieces):
        if not of:
            continue
        old = int(np.searchsorted(times, begin + after_s))
        if not known and old < len(times):
            out.append((station, of, "raised", begin, None, int(times[old]), True))
            known = True
        end = pieces[k + 1][1] if k + 1 < len(pieces) else None
        out.append((station, of, "episode", begin, end, int(ts[-1]) if end is None else end, known))
        if end is not None and known:
            out.append((station, of, "resolved", begin, None, end, True))
    last = pieces[-1]
    open_now = (last[0], last[1], int(ts[-1]), out[-1][6]) if last[0] else (None, None, int(ts[-1]), False)
    return out, open_now


def episode_events(stream: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Events of each station's episodes: opened and closed ones, alerts raised and resolved.

    The state of a station is its open episode and its newest row; rows that are not newer are skipped, so
    repeats and late rows change nothing. It has no timeout: stations stay. A group is what one trigger brings
    for one station, which the source's limit for a trigger bounds."""

    def advance(key: tuple, frames: Iterator, state: GroupState):
        rows = pd.concat([f[["snapshot_ts", "event_id", "state"]] for f in frames]).sort_values(["snapshot_ts", "event_id"], kind="stable")
        out, kept = _episode_rows(key[0], rows, state.get if state.exists else (None, None, -1, False), t.alert_after_s)
        state.update(kept)
        made = pd.DataFrame(out, columns=["station_id", "kind", "row_type", "start_ts", "end_ts", "ts", "alerted"])
        yield made.astype({"start_ts": "Int64", "end_ts": "Int64", "ts": "Int64"})

    return stream.groupBy("station_id").applyInPandasWithState(
        advance, f"station_id string, {EVENT}", "kind string, start_ts long, last_ts long, alerted boolean", "append", GroupStateTimeout.NoTimeout
    )


def drain(out: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over all that its source holds, with a checkpoint and a sink of its own; what it wrote."""
    path = shared_dir(spark)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def folded_episodes(events: DataFrame) -> DataFrame:
    """The newest word on each episode: closed if it was ever closed, else its last update."""
    rows = events.where("row_type = 'episode'")
    best = rows.groupBy("station_id", "kind", "start_ts").agg(F.max_by(F.struct("end_ts", "ts", "alerted"), F.struct(F.col("end_ts").isNotNull(), F.col("ts"))).alias("r"))
    return best.select(
        F.concat_ws(":", "station_id", "kind", F.col("start_ts").cast("string")).alias("episode_id"), "station_id", "kind", "start_ts", F.col("r.end_ts").alias("end_ts"),
        (F.coalesce("r.end_ts", "r.ts") - F.col("start_ts")).alias("duration_s"), F.when(F.col("r.end_ts").isNull(), "open").otherwise("closed").alias("status"), F.col("r.alerted").alias("alerted"),
    )
