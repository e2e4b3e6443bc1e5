"""Registered queries over tables in a lake: their commits, layouts in stages, marts that are refreshed, and sliding windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlake.operators import catalogue, health, refresh
from stationlake.operators.tables import Lake
from stationlake.plans.fragments import DAILY, SERIES, STAGED, STATUS, TRIPS, local
from stationlake.session import JobConfig
from stationlake.sources import adapters as src
from stationlake.streaming.jobs import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _day(c: str = "snapshot_ts"):
    return F.floor(F.col(c) / 86400).cast("int")


def _commits(s: SparkSession, d: str) -> DataFrame:
    """Two appends, the newest day replaced, and a compaction: what the table of commits says of them."""
    lake = Lake(s, shared_dir(s))
    rows = src.status(s, d).select("station_id", "snapshot_ts", "bikes", _day().alias("day"))
    lake.append("status", rows.where("day % 2 = 0"), ("day",))
    lake.append("status", rows.where("day % 2 = 1"), ("day",))
    top = rows.agg(F.max("day")).first()[0]
    lake.replace_partitions("status", rows.where((F.col("day") == top) & (F.col("bikes") > 0)), ("day",))
    lake.compact("status", ["station_id", "snapshot_ts"], ("day",))
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("committed_at"))
    return lake.commits("status").select("table_name", place.alias("place"), "operation", "rows", "partitions")


def _maintenance(s: SparkSession, d: str) -> DataFrame:
    """The audit rows of a run over two tables and one that is not there."""
    lake = Lake(s, shared_dir(s))
    rows = src.status(s, d).select("station_id", "snapshot_ts", _day().alias("day"))
    lake.append("status", rows, ("day",))
    lake.append("jobs", src.jobs(s, d))
    run = lake.maintain({"status": (["station_id", "snapshot_ts"], ("day",)), "jobs": (["job_id"], ()), "trips": (["month"], ("month",))}, "run-1", 100, 200)
    kept = lake.read("maintenance_runs").drop("files_before", "files_after", "bytes_before", "bytes_after")
    return kept if run is not None else run


def _stages(s: SparkSession, d: str) -> DataFrame:
    """The newest day's rows inserted hour by hour into empty tables that are partitioned by day and by hour: partitions and rows after the
    first hour, after the last, and after compaction."""
    lake, rows = Lake(s, shared_dir(s)), src.status(s, d).select("station_id", "snapshot_ts", "bikes")
    top = rows.agg(F.max(_day())).first()[0]
    # the day is read from the source once; each hour is a folder of its own
    arrived = f"{shared_dir(s)}/arrived"
    rows.where(_day() == top).withColumn("hour", F.floor(F.col("snapshot_ts") / 3600)).write.partitionBy("hour").parquet(arrived)
    day = s.read.schema("station_id string, snapshot_ts long, bikes long, hour long").parquet(arrived)
    hours = sorted(r[0] for r in day.select("hour").distinct().collect())  # 24 at most
    out = None
    for spec, size in (("by day", 86400), ("by hour", 3600)):
        table = spec.replace(" ", "_")
        lake.create(table, "station_id string, snapshot_ts long, bikes long, part long", ("part",))
        measured = []
        for hour in hours:
            lake.append(table, day.where(F.col("hour") == hour).drop("hour").withColumn("part", F.floor(F.col("snapshot_ts") / size)).coalesce(1), ("part",))
            if hour in (hours[0], hours[-1]):
                measured.append(("first hour" if hour == hours[0] else "all hours", lake.partitions(table).count(), lake.read(table).count()))
        lake.compact(table, ["station_id", "snapshot_ts"], ("part",))
        measured.append(("compacted", lake.partitions(table).count(), lake.read(table).count()))
        line = s.createDataFrame([(spec, *m) for m in measured], "spec string, stage string, partitions long, n long")
        out = line if out is None else out.unionByName(line)
    return out


def _refreshed(s: SparkSession, d: str) -> tuple[Lake, list[tuple]]:
    """Rows in two arrivals: those of the first twenty days but for late ones, then all others."""
    lake, st = Lake(s, shared_dir(s)), src.stations(s, d)
    status = src.status(s, d)
    first = (F.col("snapshot_ts") < 1704067200 + 20 * 86400) & ~((F.col("event_id") % 50 == 0) & (_day() % 5 == 0))
    told = []
    for i, rows in enumerate((status.where(first), status.where(~first))):
        days, read = refresh.arrive(lake, rows, st)
        told.append((i, len(days), read))
    return lake, told


def _cost(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(_refreshed(s, d)[1], "arrival int, days int, rows_read long")


def _minutes(s: SparkSession, d: str) -> DataFrame:
    """The window of minutes written an hour before the end, at the end, and at the end again."""
    lake, status = Lake(s, shared_dir(s)), src.status(s, d)
    end = status.agg(F.max("processed_ts")).first()[0]
    for at in (end - 3600, end, end):
        health.write_minutes(lake, status.where(F.col("processed_ts") <= at))
    return lake.read("pipeline_minutely").drop("day")


def _catalogued(s: SparkSession, d: str) -> DataFrame:
    """The declared tables, created twice in the session's catalog and filled by name."""
    config = JobConfig(prefix=f"t{uuid.uuid4().hex}_", checkpoints="lab", status_topic="lab.status", alerts_topic="lab.alerts", state_topic="lab.state").validate()
    root = shared_dir(s)
    made = catalogue.create(s, root, config)
    if len(made) != len(catalogue.TABLES) or catalogue.create(s, root, config):
        raise ValueError("tables that were there have been made again")
    status = src.status(s, d).withColumn("day", _day())
    catalogue.append(status, "silver.station_status", config)
    catalogue.append(status.select("station_id", "snapshot_ts", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "kafka_ts", F.lit(None).cast("string").alias("raw_json"), "day"), "bronze.station_status", config)
    catalogue.append(src.trips(s, d).withColumn("month", F.date_format("trip_month", "yyyy-MM")).repartition("month"), "silver.trips", config)
    return catalogue.layout(s, config)


FIRST = "snapshot_ts < 1705795200 AND NOT (event_id % 50 = 0 AND (snapshot_ts // 86400) % 5 = 0)"
UP_TO = STATUS.replace("status AS (", "everything AS (", 1) + ", status AS (SELECT * FROM everything WHERE processed_ts <= (SELECT max(processed_ts) FROM everything) - {0})"

ENTRIES: dict[str, tuple[Query, str]] = {
    "table_commits": (_commits, f"""WITH {STATUS}, s AS (SELECT *, snapshot_ts // 86400 AS day FROM status), top AS (SELECT max(day) AS top FROM s), kept AS (SELECT * FROM s, top WHERE day < top OR bikes > 0)
      SELECT 'status' AS table_name, 1 AS place, 'append' AS operation, count(*) AS rows, count(DISTINCT day) AS partitions FROM s WHERE day % 2 = 0 UNION ALL SELECT 'status', 2, 'append', count(*), count(DISTINCT day) FROM s WHERE day % 2 = 1
      UNION ALL SELECT 'status', 3, 'overwrite', count(*), count(DISTINCT day) FROM kept WHERE day = top UNION ALL SELECT 'status', 4, 'replace', count(*), count(DISTINCT day) FROM kept"""),
    "maintenance_run": (_maintenance, f"""WITH {STATUS}, n AS (SELECT 'jobs' AS table_name, count(*) AS n, 1 AS p FROM orders UNION ALL SELECT 'status', count(*), count(DISTINCT snapshot_ts // 86400) FROM status)
      SELECT 'run-1' AS run_id, table_name, 100 AS started_at, 200 AS finished_at, 'ok' AS status, CAST(NULL AS VARCHAR) AS error, n AS rows_before, n AS rows_after, 1 AS snapshots_before, 2 AS snapshots_after, 0 AS delete_files_before, 0 AS delete_files_after, 0 AS orphan_files_removed, p AS partitions_after FROM n
      UNION ALL SELECT 'run-1', 'trips', 100, 200, 'skipped', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""),
    "layout_stages": (_stages, f"""WITH {STATUS}, s AS (SELECT snapshot_ts // 3600 AS h FROM status WHERE snapshot_ts // 86400 = (SELECT max(snapshot_ts // 86400) FROM status)), a AS (SELECT count(*) FILTER (h = (SELECT min(h) FROM s)) AS n1, count(*) AS n, count(DISTINCT h) AS hours FROM s)
      SELECT spec, stage, CASE WHEN spec = 'by day' OR stage = 'first hour' THEN 1 ELSE hours END AS partitions, CASE WHEN stage = 'first hour' THEN n1 ELSE n END AS n FROM a, (VALUES ('by day'), ('by hour')) x(spec), (VALUES ('first hour'), ('all hours'), ('compacted')) y(stage)"""),
    "mart_daily_refreshed": (lambda s, d: _refreshed(s, d)[0].read(refresh.DAILY), f"WITH {DAILY} SELECT * FROM daily"),
    "mart_profile_refreshed": (lambda s, d: refresh.profile(_refreshed(s, d)[0]), f"WITH {STAGED} SELECT station_id, hour_of_day, round(least(greatest(avg(share_empty), 0), 1), 6) AS share_empty, round(least(greatest(avg(share_full), 0), 1), 6) AS share_full, count(DISTINCT service_date) AS live_days FROM staged GROUP BY 1, 2"),
    "mart_refresh_cost": (_cost, f"""WITH {STATUS}, s AS (SELECT *, CAST({local('snapshot_ts')} AS DATE) AS day, {FIRST} AS early FROM status)
      SELECT 0 AS arrival, CAST(count(DISTINCT day) AS INTEGER) AS days, count(*) AS rows_read FROM s WHERE early UNION ALL SELECT 1, CAST(count(DISTINCT day) AS INTEGER), count(*) FROM s WHERE day IN (SELECT day FROM s WHERE NOT early)"""),
    "catalog_tables": (_catalogued, f"""WITH {STATUS}, {TRIPS} SELECT 'bronze.station_status' AS table_name, count(*) AS n, count(DISTINCT snapshot_ts // 86400) AS parts FROM status UNION ALL SELECT 'silver.station_status', count(*), count(DISTINCT snapshot_ts // 86400) FROM status
      UNION ALL SELECT 'silver.trips', count(*), count(DISTINCT trip_month) FROM trips UNION ALL SELECT 'silver.availability_5m', 0, 0 UNION ALL SELECT 'metrics.maintenance_runs', 0, 0"""),
    "minutes_window": (_minutes, f"""SELECT * FROM (WITH {UP_TO.format(0)}, {SERIES} SELECT * FROM series) UNION ALL SELECT * FROM (WITH {UP_TO.format(3600)}, {SERIES} SELECT * FROM series WHERE minute < (SELECT max(processed_ts - processed_ts % 60) - 86340 FROM everything))"""),
}
