"""The status topic into four tables by four streaming queries of one source, each with a checkpoint of its own.

bronze_status   what arrived, with its raw text
silver_status   typed rows, once for each station and snapshot
availability_5m windows that are final
station_episodes, alerts, latest_state   what the stateful query says of each station (``sinks``)

The first three append a batch once, by the lake's ledger of batches; the last upserts, so that a batch that is delivered again
changes nothing. A query that dies goes on from its own checkpoint, whatever the others have done."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationlake.functions.exprs import Thresholds
from stationlake.operators import feed
from stationlake.operators.tables import Lake
from stationlake.streaming import jobs, sinks

#: The topic's columns, as a file of them holds them.
RAW = "key string, value string, topic string, partition int, offset long, timestamp long"
#: Query, the table that it appends to, and the column whose day partitions it.
APPENDS = {"bronze": ("bronze_status", "kafka_ts"), "silver": ("silver_status", "snapshot_ts"), "availability": ("availability_5m", "window_start")}
TABLES = [*(table for table, _ in APPENDS.values()), "station_episodes", "alerts", "latest_state"]
#: What a trigger holds does not grow, and neither do the partitions of a query's state: each is a file or more in every batch.
#: They are kept in the checkpoint, so a later change holds for new checkpoints only.
STATE_PARTS = 24
#: A day of a batch is dealt to so many tasks, and becomes as many files.
DAY_PARTS = 4


def files(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The topic as a stream of files."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", per_trigger).parquet(path)


def bronze(raw: DataFrame) -> DataFrame:
    return feed.bronze(raw)


def silver(raw: DataFrame, processed: Column, t: Thresholds = Thresholds()) -> DataFrame:
    return jobs.distinct_rows(feed.silver(feed.bronze(raw), processed, t)).drop("time")


def _status(rows: DataFrame) -> DataFrame:
    """Silver rows by the names that windows and episodes go by."""
    return rows.withColumnsRenamed({"num_bikes_available": "bikes", "num_docks_available": "docks"})


def availability(raw: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return jobs.availability(_status(feed.silver(feed.bronze(raw), F.lit(0), t)))


def episodes(raw: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Within a station offsets are in order, whichever partition it is in."""
    rows = feed.bronze(raw).withColumn("event_id", F.col("kafka_offset") * 1024 + F.col("kafka_partition"))
    typed = _status(feed.silver(rows, F.lit(0), t, keep=["event_id"]))
    return sinks.outputs(typed.select("station_id", "snapshot_ts", "event_id", "state", *(F.col(c).cast("long").alias(c) for c in ("bikes", "docks", "capacity"))), t)


def _append(lake: Lake, name: str):
    table, at = APPENDS[name]
    day = F.floor(F.col(at) / 86400).cast("int")

    def write(rows: DataFrame, batch: int) -> None:
        placed = rows.withColumn("day", day)
        if name != "bronze":
            # each partition of the state has rows of all days: a few tasks write a day, not every one of them; bronze comes by time
            placed = placed.repartition(STATE_PARTS, "day", F.pmod(F.xxhash64("station_id", at), F.lit(DAY_PARTS)))
        lake.append_once(table, placed, name, batch, ("day",))

    return write


@contextmanager
def _state_parts(spark: SparkSession) -> Iterator[None]:
    """Queries that start within get no more state partitions than ``STATE_PARTS``; a query takes its settings when it starts."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), STATE_PARTS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start(raw: Callable[[], DataFrame], lake: Lake, checkpoints: str, processed: Column, every: str | None = None, only: tuple[str, ...] = (), t: Thresholds = Thresholds()) -> dict[str, StreamingQuery]:
    """The four queries (or ``only`` some of them), each over a stream of its own that ``raw`` makes. With ``every``, a time, they go on
    for good; else each reads what is there and ends."""
    made = {
        "bronze": lambda: (bronze(raw()), _append(lake, "bronze")), "silver": lambda: (silver(raw(), processed, t), _append(lake, "silver")),
        "availability": lambda: (availability(raw(), t), _append(lake, "availability")), "episodes": lambda: (episodes(raw(), t), lambda rows, _: sinks.write_batch(lake, rows)),
    }
    out = {}
    for name in only or made:
        rows, write = made[name]()
        writer = rows.writeStream.foreachBatch(write).queryName(name).outputMode("append").option("checkpointLocation", f"{checkpoints}/{name}")
        with _state_parts(lake.spark):
            out[name] = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    return out


def drain(queries: dict[str, StreamingQuery]) -> None:
    """Waits for queries that end; the first failure is raised when all have been waited for."""
    failed = None
    for query in queries.values():
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001
            failed = failed or e
    if failed:
        raise failed


def read(lake: Lake, name: str) -> DataFrame:
    """The rows that a query has appended, without the day that partitions them."""
    table, _ = APPENDS[name]
    return lake.committed(table, name).drop("day")
