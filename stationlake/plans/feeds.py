"""Registered queries over the feed, its archive, and trip files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.operators import feed, snapshots, trips
from stationlake.operators.tables import Lake
from stationlake.plans.fragments import ALERTS, EPISODES, STATUS, TRIPS, local
from stationlake.sources import adapters as src
from stationlake.streaming import feeds as live
from stationlake.streaming import jobs
from stationlake.streaming.jobs import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
MESSAGES = f"""{STATUS}, msg AS (SELECT *, event_id % 2 AS docks_out, bikes // 2 AS ebikes, event_id % 89 <> 0 AS is_installed, event_id % 83 <> 0 AS is_returning, 'station_status:' || snapshot_ts AS snapshot_id FROM status WHERE event_id % 301 <> 0)"""
#: Rows of an envelope, with what is broken in them.
ROWS = f"""{STATUS}, env AS (SELECT *, CASE WHEN event_id % 211 <> 0 THEN station_id END AS sid, CASE WHEN event_id % 197 = 0 THEN -1 - bikes ELSE bikes END AS n_bikes, max(fetched_ts) OVER (PARTITION BY snapshot_ts) + 0.123 AS fetched_at FROM status),
listed AS (SELECT *, concat_ws('; ', CASE WHEN sid IS NULL THEN 'station_id missing' END, CASE WHEN event_id % 223 = 0 THEN 'is_installed missing' END, CASE WHEN n_bikes < 0 THEN 'num_bikes_available negative' END) AS errors FROM env WHERE snapshot_ts % 86400 <> 0)"""
PATHS = f"""{STATUS}, t AS (SELECT DISTINCT snapshot_ts AS t FROM status), p AS (SELECT 'station_status' AS feed, t FROM t UNION ALL SELECT 'station_information', t FROM t WHERE t % 3600 = 0),
listing AS (SELECT feed, t AS epoch, CAST(make_timestamp(t * 1000000) AS DATE) AS dt, 'raw/gbfs/' || feed || '/dt=' || strftime(make_timestamp(t * 1000000), '%Y-%m-%d') || '/' || strftime(make_timestamp(t * 1000000), '%H') || '/' || t || '.json.gz' AS path FROM p),
days AS (SELECT CAST({local("epoch")} AS DATE) AS day, count(*) AS files, min(epoch) AS first, max(epoch) AS last FROM listing WHERE feed = 'station_status' GROUP BY 1),
bounds AS (SELECT *, epoch_us(CAST(day AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') // 1000000 AS a, epoch_us(CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') // 1000000 AS b FROM days)"""
END = "(start_clock + to_seconds(duration_s))"
END_LATE = f"(epoch_us({END} AT TIME ZONE 'America/Los_Angeles') // 1000000)"
ENDED = f"CASE WHEN {local(END_LATE + ' - 3600')} = {END} THEN {END_LATE} - 3600 ELSE {END_LATE} END"


def mapped_sql(layout: str) -> str:
    odd = "duration_s % 2820 = 0"
    started = f"CASE WHEN NOT ({odd}) THEN started END"
    seconds = "duration_s" if layout == "legacy" else f"CASE WHEN NOT ({odd}) THEN ended - started END"
    ride = "start_code || '-' || started" if layout == "ride" else "CAST(NULL AS VARCHAR)"
    bike = "CAST(duration_s % 500 AS VARCHAR)" if layout == "legacy" else "CAST(NULL AS VARCHAR)"
    kind = "'electric_bike'" if layout == "ride" else "CAST(NULL AS VARCHAR)"
    return f"""{TRIPS}, e AS (SELECT *, {ENDED} AS ended FROM trips), mapped AS (SELECT trip_month, '{layout}' AS schema_version, {ride} AS ride_id, {kind} AS rideable_type, start_code AS start_station_code, CAST(NULL AS VARCHAR) AS start_station_name,
      end_code AS end_station_code, CAST(NULL AS VARCHAR) AS end_station_name, {bike} AS bike_id, 37.77 AS start_lat, CASE WHEN NOT ({odd}) THEN -122.41 END AS start_lon, 37.77 AS end_lat, CASE WHEN NOT ({odd}) THEN -122.41 END AS end_lon,
      {started} AS started_at, ended AS ended_at, {seconds} AS duration_s, rider AS member_type FROM e)"""


AUDIT = """audit AS (SELECT trip_month, schema_version, count(*) AS csv_rows, count(*) FILTER (started_at IS NULL OR ended_at IS NULL) AS bad FROM mapped GROUP BY 1, 2)
SELECT trip_month, schema_version, csv_rows, bad AS bad_timestamps, CASE WHEN bad = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN bad = 0 THEN csv_rows END AS loaded_rows, CASE WHEN bad > 0 THEN bad || ' rows without a readable time' END AS error FROM audit"""


def _mapped(layout: str) -> Query:
    return lambda s, d: trips.mapped(src.trip_files(s, d, layout))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """Trips of a rider type written as a CSV file and read back: the layout is told by the header."""
    path = f"{shared_dir(spark)}/csv"
    src.trip_files(spark, d, "legacy").drop("trip_month").write.option("header", True).option("lineSep", "\r\n").csv(path)
    read = trips.read_csv(spark, path)
    return trips.mapped(read, trips.layout_of(read.columns)).select("start_station_code", "end_station_code", "started_at", "ended_at", "duration_s", "member_type", "start_lat", "start_lon")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return trips.load(trips.mapped(src.trip_files(spark, d, "ride")), f"{shared_dir(spark)}/trips")


def _month_files(spark: SparkSession, d: str) -> DataFrame:
    """Names as the listing of a bucket has them, one of each month and more: odd ones and repeats."""
    months = src.trips(spark, d).select(F.date_format("trip_month", "yyyyMM").alias("m")).distinct()
    forms = ("{}-baywheels-tripdata.csv.zip", "{}-baywheels-tripdata.zip", "readme-{}.txt", "{}-Baywheels-tripdata.csv.zip")
    names = F.array(*(F.concat(*(F.lit(part) if i % 2 == 0 else F.col("m") for i, part in enumerate([f.split("{}")[0], "", f.split("{}")[1]]))) for f in forms))
    kept = F.when(F.substring("m", -1, 1) == "7", names).otherwise(F.slice(names, 1, 1))
    return trips.month_files(months.select(F.explode(kept).alias("name")))


def _archived(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written to the raw archive by day and hour, gzipped, and read back from two of its days."""
    path = f"{shared_dir(spark)}/archive"
    made = src.envelopes(spark, d).where("stations is not null").select("last_updated", "version", F.struct("stations").alias("data"))
    placed = made.withColumns({"dt": F.from_unixtime("last_updated", "yyyy-MM-dd"), "hour": F.from_unixtime("last_updated", "HH")})
    placed.repartition("dt").write.partitionBy("dt", "hour").option("compression", "gzip").json(f"{path}/station_status")
    days = [r[0] for r in placed.select("dt").distinct().orderBy("dt").limit(2).collect()]
    read = snapshots.read_archive(spark, path, "station_status", days).withColumn("fetched_at", F.col("last_updated").cast("double"))
    return snapshots.counts(read)


def _published(spark: SparkSession, d: str) -> DataFrame:
    """Every envelope, those of full hours fetched twice, and those of every tenth minute sent again a minute later."""
    e = src.envelopes(spark, d)
    again = e.where(F.col("last_updated") % 3600 == 0).withColumn("fetched_at", F.col("fetched_at") + 20)
    later = e.where(F.col("last_updated") % 600 == 0).withColumns({"last_updated": F.col("last_updated") + 1, "fetched_at": F.col("fetched_at") + 30})
    return snapshots.published(e.unionByName(again).unionByName(later)).select("feed", "last_updated", "repeated", "unchanged")


def _day(spark: SparkSession, d: str) -> DataFrame:
    listing = snapshots.listed(src.archive(spark, d))
    return snapshots.of_local_day(listing, "station_status", snapshots.complete_day(snapshots.local_days(listing, "station_status"), "2024-01-20"))


def _replay(spark: SparkSession, d: str) -> DataFrame:
    sent = snapshots.replayed(snapshots.messages(src.envelopes(spark, d)), 19732, 20, 50)
    at = lambda p, t: F.get_json_object("value", p).cast(t)
    return sent.select("key", "place", at("$.feed_last_updated", "long").alias("snapshot_ts"), at("$.num_bikes_available", "int").alias("bikes"), at("$.replay", "boolean").alias("replay"))


BRONZE = "station_id num_bikes_available num_bikes_disabled num_docks_available num_docks_disabled num_ebikes_available is_installed is_renting is_returning last_reported_ts snapshot_ts fetched_ts feed_version snapshot_id kafka_topic kafka_partition kafka_offset kafka_ts num_scooters_available num_scooters_unavailable".split()
BRONZE_SQL = f"""WITH {MESSAGES} SELECT station_id, bikes AS num_bikes_available, disabled AS num_bikes_disabled, docks AS num_docks_available, docks_out AS num_docks_disabled, ebikes AS num_ebikes_available, is_installed, is_renting, is_returning, last_reported_ts, snapshot_ts, fetched_ts + 0.25 AS fetched_ts,
  '2.3' AS feed_version, snapshot_id, 'gbfs.station_status' AS kafka_topic, part AS kafka_partition, off AS kafka_offset, kafka_ts, event_id % 4 AS num_scooters_available, event_id % 5 AS num_scooters_unavailable FROM msg
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'gbfs.station_status', part, off, kafka_ts, NULL, NULL FROM status WHERE event_id % 301 = 0"""
SILVER_SQL = f"""WITH {MESSAGES}, c AS (SELECT *, bikes + disabled + docks + docks_out AS cap FROM msg) SELECT station_id, snapshot_ts, last_reported_ts, bikes AS num_bikes_available, disabled AS num_bikes_disabled, ebikes AS num_ebikes_available, docks AS num_docks_available, docks_out AS num_docks_disabled, cap AS capacity,
  is_installed, is_renting, is_returning, CASE WHEN NOT is_installed OR NOT is_renting OR snapshot_ts - last_reported_ts > 1800 THEN 'offline' WHEN bikes = 0 THEN 'empty' WHEN docks = 0 THEN 'full' WHEN bikes <= 2 OR bikes <= cap * 0.1 THEN 'low' WHEN docks <= 2 OR docks <= cap * 0.1 THEN 'high' ELSE 'ok' END AS state,
  fetched_ts + 0.25 AS fetched_ts, kafka_ts, kafka_ts + 60 AS processed_ts, event_id % 4 AS num_scooters_available FROM c"""



def _streamed(s: SparkSession, d: str, *only: str) -> Lake:
    """The status topic as files in order of time, read by the four queries, or by ``only`` some of them."""
    raw = src.status_messages(s, d)
    at = F.coalesce(F.get_json_object("value", "$.feed_last_updated").cast("long"), "timestamp")
    folder, per_trigger = jobs.as_files(raw.withColumn("at", at), ("at", "event_id"))
    path = shared_dir(s)
    lake = Lake(s, f"{path}/lake")
    live.drain(live.start(lambda: live.files(s, folder, per_trigger), lake, f"{path}/checkpoints", F.col("kafka_ts") + 60, only=only))
    return lake


def _four(s: SparkSession, d: str) -> DataFrame:
    """Of each table of the four queries, run at the same time: rows, and the newest time in it."""
    lake, out = _streamed(s, d), None
    tables = {"bronze_status": (live.read(lake, "bronze"), "kafka_ts"), "silver_status": (live.read(lake, "silver"), "snapshot_ts"), "availability_5m": (live.read(lake, "availability"), "window_start"), "station_episodes": (lake.rows("station_episodes"), "start_ts"), "alerts": (lake.rows("alerts"), "ts")}
    for name, (rows, at) in tables.items():
        line = rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.max(at).alias("newest"), F.sum(at).alias("total"))
        out = line if out is None else out.unionByName(line)
    return out


#: The first row of each station and snapshot, as the streams keep it.
SILVER_ONCE = SILVER_SQL + " QUALIFY row_number() OVER (PARTITION BY station_id, snapshot_ts ORDER BY event_id) = 1"
TOTALS = "SELECT '{0}' AS table_name, count(*) AS n, max({1}) AS newest, CAST(sum({1}) AS BIGINT) AS total FROM {2}"

ENTRIES: dict[str, tuple[Query, str]] = {
    "bronze_status": (lambda s, d: feed.bronze(src.status_messages(s, d)).select(*BRONZE), BRONZE_SQL),
    "silver_from_bronze": (lambda s, d: feed.silver(feed.bronze(src.status_messages(s, d)), F.col("kafka_ts") + 60), SILVER_SQL),
    "stream_bronze": (lambda s, d: live.read(_streamed(s, d, "bronze"), "bronze").select(*BRONZE), BRONZE_SQL),
    "stream_silver": (lambda s, d: live.read(_streamed(s, d, "silver"), "silver"), SILVER_ONCE),
    "stream_four_tables": (_four, f"""WITH bronze AS ({BRONZE_SQL}), silver AS ({SILVER_ONCE}), status AS (SELECT station_id, snapshot_ts, state, 0 AS event_id FROM silver), {EPISODES}, {ALERTS},
      w AS (SELECT DISTINCT station_id, snapshot_ts - snapshot_ts % 300 AS window_start FROM silver WHERE snapshot_ts - snapshot_ts % 300 + 300 <= (SELECT max(snapshot_ts) - 600 FROM silver))
      {TOTALS.format('bronze_status', 'kafka_ts', 'bronze')} UNION ALL {TOTALS.format('silver_status', 'snapshot_ts', 'silver')} UNION ALL {TOTALS.format('availability_5m', 'window_start', 'w')}
      UNION ALL {TOTALS.format('station_episodes', 'start_ts', 'episodes')} UNION ALL {TOTALS.format('alerts', 'ts', 'alerts')}"""),
    "snapshot_messages": (lambda s, d: snapshots.messages(src.envelopes(s, d)), f"""WITH {ROWS} SELECT sid AS "key", event_id, n_bikes AS num_bikes_available, docks AS num_docks_available, true AS is_installed, is_renting, event_id % 83 <> 0 AS is_returning, last_reported_ts AS last_reported, snapshot_ts AS feed_last_updated, '2.3' AS feed_version, round(fetched_at, 3) AS fetched_at, 'station_status:' || snapshot_ts AS snapshot_id FROM listed WHERE errors = ''"""),
    "snapshot_rejects": (lambda s, d: snapshots.rejects(src.envelopes(s, d)).select("key", "snapshot_id", "errors", F.get_json_object("payload", "$.num_bikes_available").cast("long").alias("bikes")), f"""WITH {ROWS} SELECT coalesce(sid, 'station_status:' || snapshot_ts) AS "key", 'station_status:' || snapshot_ts AS snapshot_id, errors, n_bikes AS bikes FROM listed WHERE errors <> '' UNION ALL SELECT DISTINCT 'station_status:' || snapshot_ts, 'station_status:' || snapshot_ts, 'stations missing', CAST(NULL AS BIGINT) FROM env WHERE snapshot_ts % 86400 = 0"""),
    "snapshot_counts": (lambda s, d: snapshots.counts(src.envelopes(s, d)), f"""WITH {ROWS} SELECT 'station_status:' || snapshot_ts AS snapshot_id, count(*) FILTER (errors = '') AS messages, count(*) FILTER (errors <> '') AS rejects FROM listed GROUP BY 1 UNION ALL SELECT DISTINCT 'station_status:' || snapshot_ts, 0, 1 FROM env WHERE snapshot_ts % 86400 = 0"""),
    "snapshots_published": (_published, f"""WITH {STATUS}, t AS (SELECT DISTINCT snapshot_ts AS t FROM status) SELECT 'station_status' AS feed, t AS last_updated, false AS repeated, false AS unchanged FROM t UNION ALL SELECT 'station_status', t, true, false FROM t WHERE t % 3600 = 0 UNION ALL SELECT 'station_status', t + 1, false, t % 86400 <> 0 FROM t WHERE t % 600 = 0"""),
    "replay_messages": (_replay, f"""WITH {ROWS}, r AS (SELECT *, dense_rank() OVER (ORDER BY snapshot_ts) AS place FROM listed WHERE errors = '' AND snapshot_ts // 86400 = 19732) SELECT sid AS "key", place, snapshot_ts, n_bikes AS bikes, true AS replay FROM r WHERE place BETWEEN 21 AND 70"""),
    "archive_read": (_archived, f"""WITH {ROWS}, two AS (SELECT DISTINCT snapshot_ts // 86400 AS day FROM listed ORDER BY 1 LIMIT 2) SELECT 'station_status:' || snapshot_ts AS snapshot_id, count(*) FILTER (errors = '') AS messages, count(*) FILTER (errors <> '') AS rejects FROM listed WHERE snapshot_ts // 86400 IN (SELECT day FROM two) GROUP BY 1"""),
    "archive_listing": (lambda s, d: snapshots.listed(src.archive(s, d)), f"WITH {PATHS} SELECT path, feed, dt, epoch FROM listing"),
    "archive_days": (lambda s, d: snapshots.local_days(snapshots.listed(src.archive(s, d)), "station_status"), f"WITH {PATHS} SELECT day, files, first, last, (b - a) // 3600 AS day_hours FROM bounds"),
    "archive_day_files": (_day, f"WITH {PATHS}, d AS (SELECT * FROM bounds WHERE day = coalesce((SELECT max(day) FROM days WHERE day < DATE '2024-01-20'), DATE '2024-01-20')) SELECT (epoch - a) // 900 AS bucket, max(epoch) AS epoch, arg_max(path, epoch) AS path FROM listing, d WHERE feed = 'station_status' AND epoch >= a AND epoch < b GROUP BY 1"),
    "archive_newest_before": (lambda s, d: (lambda l: snapshots.newest_before(l, "station_information", snapshots.local_days(l, "station_status")))(snapshots.listed(src.archive(s, d))), f"WITH {PATHS} SELECT day, (SELECT arg_max(path, epoch) FROM listing l WHERE feed = 'station_information' AND l.epoch < x.b) AS path FROM bounds x"),
    "map_trips_ride": (_mapped("ride"), f"WITH {mapped_sql('ride')} SELECT * FROM mapped"),
    "map_trips_both": (lambda s, d: _mapped("legacy")(s, d).unionByName(_mapped("ride")(s, d)).groupBy("schema_version", "member_type", "start_station_code").agg(F.count(F.lit(1)).alias("n"), F.count("started_at").alias("timed"), F.sum("duration_s").alias("seconds")), f"SELECT schema_version, member_type, start_station_code, count(*) AS n, count(started_at) AS timed, CAST(sum(duration_s) AS BIGINT) AS seconds FROM (SELECT * FROM (WITH {mapped_sql('legacy')} SELECT * FROM mapped) UNION ALL SELECT * FROM (WITH {mapped_sql('ride')} SELECT * FROM mapped)) GROUP BY 1, 2, 3"),
    "trips_from_csv": (_csv, f"WITH {mapped_sql('legacy')} SELECT start_station_code, end_station_code, started_at, ended_at, duration_s, member_type, start_lat, start_lon FROM mapped"),
    "trip_load_audit": (_audit, f"WITH {mapped_sql('ride')}, {AUDIT}"),
    "month_files": (_month_files, f"WITH {TRIPS}, m AS (SELECT DISTINCT trip_month, strftime(trip_month, '%Y%m') AS k FROM trips) SELECT trip_month, CASE WHEN k LIKE '%7' THEN k || '-baywheels-tripdata.csv.zip' ELSE k || '-baywheels-tripdata.csv.zip' END AS name, CASE WHEN k LIKE '%7' THEN 2 ELSE 1 END AS files, k LIKE '%7' AS ambiguous FROM m"),
}
