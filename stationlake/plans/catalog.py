"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.operators import availability as av
from stationlake.operators import cdc, digests, documents, episodes, feed, fleet, health, marts, quality
from stationlake.operators.tables import Lake
from stationlake.plans import feeds, lakes, replica, reports
from stationlake.plans.fragments import ALERTS, APPLIED, CHANGES, DAILY, EPISODES, FRAMES, HOURLY, JOBS, LIVE, MEANS, REBALANCING, SERIES, STATIONS, STATUS, TRIPS, WINDOWS, local
from stationlake.sources import adapters as src
from stationlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return av.staged(av.windows(src.status(spark, d)))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return marts.daily(_staged(spark, d), src.stations(spark, d))


def _rebalancing(spark: SparkSession, d: str) -> DataFrame:
    return marts.rebalancing(_staged(spark, d), episodes.episodes(src.status(spark, d)), src.stations(spark, d))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return marts.trips_vs_availability(_staged(spark, d), src.trips(spark, d), src.stations(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _with_bad(parsed: DataFrame) -> DataFrame:
    """Some rows with a count below zero, as a broken feed sends them."""
    return parsed.withColumn("num_bikes_available", F.when(F.col("event_id") % 197 == 0, -1 - F.col("num_bikes_available")).otherwise(F.col("num_bikes_available")))


def _replica(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of change events applied one after the other."""
    log = src.changelog(spark, d)
    return cdc.merge(cdc.merge(cdc.empty(log), log.where("lsn % 2 = 0")), log.where("lsn % 2 = 1"))


def _availability_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.source(spark, *jobs.as_files(src.status(spark, d)))
    return _rounded(jobs.drain(jobs.availability(rows), spark))


def _episodes_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.source(spark, *jobs.as_files(src.status(spark, d)))
    return jobs.folded_episodes(jobs.drain(jobs.episode_events(rows), spark))


def _deduped_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.source(spark, *jobs.as_files(src.status(spark, d)))
    kept = jobs.drain(jobs.distinct_rows(rows).select("station_id", "snapshot_ts"), spark)
    return kept.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("snapshot_ts").alias("newest"))


def _replay(spark: SparkSession, d: str) -> DataFrame:
    """The second batch is delivered again: nothing changes."""
    return cdc.merge(_replica(spark, d), src.changelog(spark, d).where("lsn % 2 = 1"))


def _replace_month(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of the trips' table; the second replaces the newest month with its member trips only."""
    lake = Lake(spark, jobs.shared_dir(spark))
    t = src.trips(spark, d).select("trip_month", "rider", "duration_s", "started").withColumn("month", F.date_format("trip_month", "yyyy-MM"))
    ok = F.col("started").isNotNull()
    lake.replace_partitions("trips", t.repartition("month"), ("month",), ok)
    newest = t.agg(F.max("month")).first()[0]
    lake.replace_partitions("trips", t.where((F.col("month") == newest) & (F.col("rider") == "member")), ("month",), ok)
    return lake.read("trips").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_s").alias("seconds"))


def _compaction(spark: SparkSession, d: str) -> DataFrame:
    """Rows by station of a table after its small files have been written anew."""
    lake = Lake(spark, jobs.shared_dir(spark))
    lake.append("status", src.status(spark, d).select("station_id", "snapshot_ts", "bikes").repartition(16))
    lake.compact("status", ["station_id", "snapshot_ts"])
    return lake.read("status").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("snapshot_ts").alias("newest"), F.sum("bikes").alias("bikes"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    """The same rows partitioned by day and by hour, loaded hour by hour into an empty copy: partitions, files, rows and bytes of each."""
    lake, rows = Lake(spark, jobs.shared_dir(spark)), src.status(spark, d).select("station_id", "snapshot_ts", "bikes")
    out = None
    for spec, size in (("day", 86400), ("hour", 3600)):
        lake.append(spec, rows.withColumn("part", F.floor(F.col("snapshot_ts") / size).cast("long")).repartition("part"), ("part",))
        files = lake.files(spec).withColumn("spec", F.lit(spec))
        out = files if out is None else out.unionByName(files)
    return fleet.layout(out)


def _due(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that get a job, and when; one in seven has been handled before."""
    found = episodes.episodes(src.status(spark, d))
    return fleet.due(found, src.dispatch_jobs(spark, d), found.where("start_ts % 7 = 0"))


def _differences(spark: SparkSession, d: str) -> DataFrame:
    """The replica as it would be without deletions against the one with them, from stored hashes."""
    lake, log = Lake(spark, jobs.shared_dir(spark)), src.changelog(spark, d).drop("status")  # not compared
    digests.stored(lake, "left", cdc.newest(log.where("op <> 'd'")), cdc.KEY, ["lsn", "op", "quantity"], digits=1)
    digests.stored(lake, "right", cdc.newest(log), cdc.KEY, ["lsn", "op", "quantity"], digits=1)
    return digests.difference(lake, "left", "right", cdc.KEY)


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Micro-batches of one table by the second they were processed in, and the commits that took them: a commit in 50 was lost."""
    b = src.status(spark, d).groupBy(F.lit("status").alias("table_name"), F.col("processed_ts").alias("batch_ts")).agg(F.count(F.lit(1)).alias("n"))
    return b, b.where("batch_ts % 50 != 0").select("table_name", (F.col("batch_ts") + 7 + F.col("batch_ts") % 3).alias("commit_ts"), "n")


def _sustained(spark: SparkSession, d: str) -> DataFrame:
    b, commits = _batches(spark, d)
    groups = src.status(spark, d).groupBy(F.lit("status").alias("table_name"), F.col("processed_ts").alias("batch_ts"), "fetched_ts").agg(F.count(F.lit(1)).alias("n"))
    return health.sustained(groups, health.pair_batches(b, commits))


#: f(i) and the running maximum of f(j) - j among batches and commits of one size; pairs that go back in time are undone.
PAIRED = """b AS (SELECT processed_ts AS batch_ts, count(*) AS n FROM status GROUP BY 1), c AS (SELECT batch_ts + 7 + batch_ts % 3 AS commit_ts, n FROM b WHERE batch_ts % 50 <> 0),
cs AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY commit_ts) AS k FROM c WHERE commit_ts <= (SELECT max(batch_ts) + 900 FROM b)),
f AS (SELECT b.batch_ts, b.n, row_number() OVER (PARTITION BY b.n ORDER BY b.batch_ts) AS i, (SELECT count(*) FROM cs WHERE cs.n = b.n AND cs.commit_ts <= b.batch_ts) + 1 AS f FROM b),
g AS (SELECT *, max(f - i) OVER (PARTITION BY n ORDER BY i) + i AS k FROM f), t AS (SELECT g.batch_ts, g.n, cs.commit_ts FROM g LEFT JOIN cs ON g.n = cs.n AND g.k = cs.k),
pairs AS (SELECT 'status' AS table_name, batch_ts, n, CASE WHEN coalesce(commit_ts > max(commit_ts) OVER (ORDER BY batch_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN commit_ts END AS commit_ts FROM t)"""


STREAM_SHARES = ", ".join(f"round(avg(CASE WHEN state = '{x}' THEN 1.0 ELSE 0 END), 6) AS share_{x}" for x in ("empty", "full", "offline"))
HOURS = ", ".join(f"max(CASE WHEN hour_of_day = {h} THEN share_empty END) AS h{h:02d}" for h in range(24))
END_LATE = "(epoch_us((start_clock + to_seconds(duration_s)) AT TIME ZONE 'America/Los_Angeles') // 1000000)"


ENTRIES: dict[str, tuple[Query, str]] = {
    "silver_status": (lambda s, d: src.status(s, d).select("event_id", "station_id", "snapshot_ts", "last_reported_ts", "bikes", "docks", "disabled", "capacity", "is_renting", "state", "fetched_ts", "kafka_ts"), f"WITH {STATUS} SELECT event_id, station_id, snapshot_ts, last_reported_ts, bikes, docks, disabled, capacity, is_renting, state, fetched_ts, kafka_ts FROM status"),
    "parse_status": (lambda s, d: feed.parse(src.messages(s, d)).select("event_id", "partition", "offset", "station_id", "last_updated", "last_reported", "num_bikes_available", "num_docks_available", "is_renting", "fetched_at"), f'WITH {STATUS} SELECT event_id, part AS "partition", off AS "offset", station_id, snapshot_ts AS last_updated, last_reported_ts AS last_reported, bikes AS num_bikes_available, docks AS num_docks_available, is_renting, fetched_ts AS fetched_at FROM status'),
    "validate_split": (lambda s, d: feed.split_counts(_with_bad(feed.parse(src.messages(s, d)))), f"WITH {STATUS} SELECT snapshot_ts AS last_updated, count(*) FILTER (event_id % 197 <> 0) AS good, count(*) FILTER (event_id % 197 = 0) AS rejected FROM status GROUP BY 1"),
    "reject_reasons": (lambda s, d: feed.reject_reasons(_with_bad(feed.parse(src.messages(s, d)))), f"WITH {STATUS} SELECT 'negative bikes' AS error, count(*) AS n FROM status WHERE event_id % 197 = 0 HAVING count(*) > 0"),
    "dedupe_regions": (lambda s, d: feed.first_of(src.stations(s, d), "region_id", "station_id", ["station_name", "short_name"]), f"WITH {STATIONS} SELECT region_id, arg_min(station_name, station_id) AS station_name, arg_min(short_name, station_id) AS short_name FROM stations GROUP BY 1"),
    "station_dimension": (lambda s, d: feed.first_of(src.messages(s, d).select("key", "event_id", "partition", "kafka_ts"), "key", "event_id", ["partition", "kafka_ts"]), f'WITH {STATUS} SELECT station_id AS "key", arg_min(part, event_id) AS "partition", arg_min(kafka_ts, event_id) AS kafka_ts FROM status GROUP BY 1'),
    "latest_per_key": (lambda s, d: feed.latest_per_key(src.messages(s, d)).select("key", "kafka_ts", "partition", "offset", F.get_json_object("value", "$.num_bikes_available").cast("long").alias("bikes")), f'WITH {STATUS} SELECT station_id AS "key", kafka_ts, part AS "partition", off AS "offset", bikes FROM status QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY kafka_ts DESC, part DESC, off DESC) = 1'),
    "archive_slice": (lambda s, d: feed.slice_(src.status(s, d), 100, 50).select("event_id", "snapshot_ts", F.col("place").cast("long").alias("place")), f"WITH {STATUS} SELECT event_id, snapshot_ts, place FROM (SELECT event_id, snapshot_ts, dense_rank() OVER (ORDER BY snapshot_ts) AS place FROM status) WHERE place BETWEEN 101 AND 150"),
    "unchanged_days": (lambda s, d: feed.unchanged(src.status(s, d)), f"""WITH {STATUS}, c AS (SELECT station_id, snapshot_ts // 86400 AS day, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256((snapshot_ts % 86400) || ',' || bikes), 1, 15) AS BIGINT)) % 1152921504606846976 AS BIGINT) AS content FROM status GROUP BY 1, 2)
      SELECT *, coalesce(content = lag(content) OVER w AND n = lag(n) OVER w, false) AS unchanged FROM c WINDOW w AS (PARTITION BY station_id ORDER BY day)"""),
    "availability_5m": (lambda s, d: _rounded(av.windows(src.status(s, d))), f"WITH {WINDOWS} SELECT window_start, window_end, station_id, samples, min_bikes, round(avg_bikes, 6) AS avg_bikes, max_bikes, round(avg_docks, 6) AS avg_docks, capacity, round(share_empty, 6) AS share_empty, round(share_full, 6) AS share_full, round(share_offline, 6) AS share_offline FROM w"),
    "episodes_batch": (lambda s, d: episodes.episodes(src.status(s, d)), f"WITH {STATUS}, {EPISODES} SELECT * FROM episodes"),
    "availability_5m_stream": (_availability_stream, f"""WITH {STATUS}, f AS (SELECT * FROM status QUALIFY row_number() OVER (PARTITION BY station_id, snapshot_ts ORDER BY event_id) = 1)
      SELECT snapshot_ts - snapshot_ts % 300 AS window_start, snapshot_ts - snapshot_ts % 300 + 300 AS window_end, station_id, count(*) AS samples, min(bikes) AS min_bikes, round(avg(bikes), 6) AS avg_bikes, max(bikes) AS max_bikes, round(avg(docks), 6) AS avg_docks, max(capacity) AS capacity, {STREAM_SHARES}
      FROM f GROUP BY 1, 2, 3 HAVING max(snapshot_ts - snapshot_ts % 300) + 300 <= (SELECT max(snapshot_ts) - 600 FROM status)"""),
    "episodes_stream": (_episodes_stream, f"WITH {STATUS}, {EPISODES} SELECT * FROM episodes"),
    "dedupe_stream": (_deduped_stream, f"WITH {STATUS} SELECT station_id, count(DISTINCT snapshot_ts) AS n, max(snapshot_ts) AS newest FROM status GROUP BY 1"),
    "alerts": (lambda s, d: episodes.alerts(src.status(s, d)), f"WITH {STATUS}, {EPISODES}, {ALERTS} SELECT * FROM alerts"),
    "latest_state": (lambda s, d: documents.latest(src.status(s, d)).select("station_id", "snapshot_ts", "state", "bikes", "docks", "capacity"), f"WITH {STATUS} SELECT station_id, snapshot_ts, state, bikes, docks, capacity FROM status QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY snapshot_ts DESC, event_id DESC) = 1"),
    "mart_station_availability_daily": (lambda s, d: _daily(s, d), f"WITH {DAILY} SELECT * FROM daily"),
    "mart_rebalancing_need": (lambda s, d: _rebalancing(s, d), f"WITH {REBALANCING} SELECT * FROM rebalancing"),
    "mart_trips_vs_availability": (lambda s, d: _hourly(s, d), f"WITH {HOURLY} SELECT * FROM hourly"),
    "kpi_tiles": (lambda s, d: marts.kpis(_daily(s, d), _hourly(s, d)), f"WITH {HOURLY}, daily AS (SELECT sum(minutes_empty) AS e, sum(minutes_full) AS f, sum(c) AS c FROM (SELECT round(sum(share_empty) * 5, 6) AS minutes_empty, round(sum(share_full) * 5, 6) AS minutes_full, round(count(*) / 12.0, 6) AS c FROM staged JOIN stations USING (station_id) GROUP BY station_id, service_date)), h AS (SELECT hour_of_day, round(avg(share_empty), 6) AS s FROM hourly GROUP BY 1) SELECT round(e / (c * 60), 6) AS time_empty, round(f / (c * 60), 6) AS time_full, (SELECT hour_of_day FROM h ORDER BY s DESC, hour_of_day LIMIT 1) AS worst_hour, (SELECT max(s) FROM h) AS worst_share, (SELECT round(sum(trips_started_per_day), 3) FROM hourly) AS trips_per_day FROM daily"),
    "station_profiles": (lambda s, d: marts.profiles(_hourly(s, d)), f"WITH {HOURLY} SELECT station_id, {HOURS} FROM hourly GROUP BY 1"),
    "quarters": (lambda s, d: marts.quarters(_hourly(s, d)), f"WITH {HOURLY}, {MEANS}, r AS (SELECT *, greatest(count(*) OVER () // 4, 1) AS q, row_number() OVER (ORDER BY trips_per_day DESC, station_id) AS busy, row_number() OVER (ORDER BY trips_per_day, station_id) AS quiet FROM means) SELECT round(avg(mean_share) FILTER (busy <= q), 6) AS busiest, round(avg(mean_share) FILTER (quiet <= q), 6) AS quietest FROM r"),
    "heatmap_top25": (lambda s, d: marts.heatmap(_hourly(s, d)), f"WITH {HOURLY}, {MEANS} SELECT *, CASE WHEN mean_share * 100 < 5 THEN 1 WHEN mean_share * 100 < 15 THEN 2 WHEN mean_share * 100 < 30 THEN 3 WHEN mean_share * 100 < 50 THEN 4 ELSE 5 END AS bucket FROM means ORDER BY mean_share DESC, station_name LIMIT 25"),
    "rebalancing_top20": (lambda s, d: _rebalancing(s, d).where("need_rank <= 20").orderBy("need_rank", "station_id"), f"WITH {REBALANCING} SELECT * FROM rebalancing WHERE need_rank <= 20"),
    "trip_code_match": (lambda s, d: marts.code_match(src.trips(s, d), src.stations(s, d)), f"WITH {STATIONS}, {TRIPS} SELECT count(*) AS trips, round(avg(CASE WHEN short_name IS NULL THEN 0.0 ELSE 1 END), 6) AS match_rate FROM trips LEFT JOIN stations ON start_code = short_name"),
    "map_trips_legacy": (lambda s, d: fleet.mapped(fleet.raw_trips(src.trips(s, d))), f"WITH {TRIPS} SELECT start_code, end_code, started, CASE WHEN {local(END_LATE + ' - 3600')} = start_clock + to_seconds(duration_s) THEN {END_LATE} - 3600 ELSE {END_LATE} END AS ended, duration_s, rider FROM trips"),
    "trip_load_check": (lambda s, d: fleet.checked(fleet.mapped(fleet.raw_trips(src.trips(s, d)))), f"WITH {TRIPS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS no_code, CAST(sum(duration_s) AS BIGINT) AS seconds FROM trips"),
    "month_status": (lambda s, d: fleet.month_status(src.trips(s, d)), f"WITH {TRIPS}, have AS (SELECT trip_month, count(*) AS trips FROM trips GROUP BY 1), m AS (SELECT CAST(unnest(range(CAST((SELECT min(trip_month) FROM have) AS TIMESTAMP), CAST((SELECT max(trip_month) FROM have) AS TIMESTAMP) + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS DATE) AS trip_month) SELECT trip_month, coalesce(trips, 0) AS trips, CASE WHEN trips IS NOT NULL THEN 'published' WHEN trip_month < (SELECT max(trip_month) FROM have) THEN 'missing' ELSE 'pending' END AS status FROM m LEFT JOIN have USING (trip_month)"),
    "cdc_latest": (lambda s, d: cdc.newest(src.changelog(s, d)), f'WITH {CHANGES} SELECT order_id, line, lsn, off AS "offset", op, quantity, status FROM newest'),
    "cdc_apply": (_replica, f"WITH {CHANGES}, {APPLIED}"),
    "cdc_replay": (_replay, f"WITH {CHANGES}, {APPLIED}"),
    "replace_month": (_replace_month, f"WITH {TRIPS}, m AS (SELECT max(trip_month) AS m FROM trips) SELECT strftime(trip_month, '%Y-%m') AS \"month\", count(*) AS n, CAST(sum(duration_s) AS BIGINT) AS seconds FROM trips, m WHERE trip_month < m OR rider = 'member' GROUP BY 1"),
    "compaction": (_compaction, f"WITH {STATUS} SELECT station_id, count(*) AS n, max(snapshot_ts) AS newest, CAST(sum(bikes) AS BIGINT) AS bikes FROM status GROUP BY 1"),
    "layout_report": (_layout, ""),
    "pair_batches": (lambda s, d: health.pair_batches(*_batches(s, d)), f"WITH {STATUS}, {PAIRED} SELECT * FROM pairs"),
    "sustained_report": (_sustained, f"""WITH {STATUS}, {PAIRED}, d AS (SELECT commit_ts - batch_ts AS s FROM pairs WHERE commit_ts IS NOT NULL), l AS (SELECT commit_ts - fetched_ts AS s FROM status JOIN pairs ON processed_ts = batch_ts WHERE commit_ts IS NOT NULL)
      SELECT 'status' AS table_name, (SELECT count(*) FROM pairs) AS batches, (SELECT count(*) FROM pairs WHERE commit_ts IS NULL) AS unpaired, CAST(quantile_disc(s, 0.5) AS BIGINT) AS batch_p50_s, CAST(quantile_disc(s, 0.95) AS BIGINT) AS batch_p95_s, max(s) AS batch_max_s,
        (SELECT CAST(quantile_disc(s, 0.5) AS BIGINT) FROM l) AS commit_p50_s, (SELECT CAST(quantile_disc(s, 0.95) AS BIGINT) FROM l) AS commit_p95_s, (SELECT count(*) FROM pairs WHERE commit_ts IS NULL) = 0 AND max(s) < 60 AS sustained FROM d"""),
    "live_document": (lambda s, d: documents.document(documents.live(src.status(s, d), src.stations(s, d)), ["station_id", "name", "view", "state", "bikes", "docks"], ["place", "name", "station_id"], {"format": "1"}), f"""WITH {STATUS}, {STATIONS}, {LIVE}, t AS (SELECT '{{"format":"1","columns":["station_id","name","view","state","bikes","docks"],"rows":[' || string_agg('["' || concat_ws('","', station_id, name, view, state, bikes, docks) || '"]', ',' ORDER BY place, name, station_id) || ']}}' AS document FROM live) SELECT document, CAST(strlen(document) AS INTEGER) AS bytes FROM t"""),
    "alert_texts": (lambda s, d: episodes.alert_texts(episodes.alerts(src.status(s, d)), src.stations(s, d)), f"""WITH {STATUS}, {STATIONS}, {EPISODES}, {ALERTS},
      t AS (SELECT alert_id, action, coalesce(station_name, station_id) AS name, CASE kind WHEN 'empty' THEN 'no bikes' ELSE 'no free docks' END AS what, CAST(round_even(duration_s / 60.0, 0) AS BIGINT) || ' min' AS m, strftime({local('start_ts')}, '%-I:%M %p') || ' Pacific' AS clock FROM alerts LEFT JOIN stations USING (station_id))
      SELECT alert_id, left(CASE action WHEN 'raised' THEN name || ': ' || what || ' for ' || m ELSE name || ': back in order' END, 100) AS subject,
        CASE action WHEN 'raised' THEN 'Since ' || clock || ' there are ' || what || ' at ' || name || ': ' || m || ' up to now.' ELSE 'What began at ' || clock || ' at ' || name || ' is over after ' || m || '.' END AS body FROM t"""),
    "cdc_op_counts": (lambda s, d: cdc.op_counts(src.changelog(s, d)), f"WITH {CHANGES} SELECT status, count(*) FILTER (op = 'c') AS c, count(*) FILTER (op = 'u') AS u, count(*) FILTER (op = 'd') AS d, count(*) FILTER (op = 'r') AS r FROM log GROUP BY 1"),
    "table_checksum": (lambda s, d: cdc.checksum(src.changelog(s, d), ["order_id", "line", "lsn", "op", "quantity"]), f"WITH {CHANGES} SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(31), order_id, line, lsn, op, quantity)), 1, 15)) AS BIGINT)) % 1152921504606846976 AS BIGINT) AS digest FROM log"),
    "replica_diff": (lambda s, d: _differences(s, d), f"WITH {CHANGES}, l AS (SELECT * FROM log WHERE op <> 'd' QUALIFY row_number() OVER (PARTITION BY order_id, line ORDER BY lsn DESC, off DESC) = 1) SELECT coalesce(l.order_id, r.order_id) AS order_id, coalesce(l.line, r.line) AS line, CASE WHEN l.lsn IS NULL THEN 'only right' WHEN r.lsn IS NULL THEN 'only left' ELSE 'differs' END AS problem FROM l FULL OUTER JOIN newest r ON l.order_id = r.order_id AND l.line = r.line WHERE l.lsn IS DISTINCT FROM r.lsn OR l.op IS DISTINCT FROM r.op OR l.quantity IS DISTINCT FROM r.quantity"),
    "changed_upsert": (lambda s, d: cdc.changed(src.jobs(s, d), src.jobs(s, d).withColumn("status", F.when(F.col("priority").startswith("1"), "done").otherwise(F.col("status"))), ["job_id"], ["status", "priority"]), f"WITH {JOBS} SELECT job_id, station_id, 'done' AS status, opened_at, priority FROM jobs WHERE priority LIKE '1%' AND status <> 'done'"),
    "expectations": (lambda s, d: quality.expectations(src.status(s, d)), f"WITH {STATUS}, day AS (SELECT * FROM status WHERE snapshot_ts > (SELECT max(snapshot_ts) FROM status) - 86400), n AS (SELECT count(*) AS n FROM day), u AS (SELECT coalesce(CAST(sum(c) FILTER (c > 1) AS BIGINT), 0) AS x, CAST(sum(c) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM day GROUP BY station_id, snapshot_ts)), r AS (SELECT * FROM (VALUES ('row count'), ('station_id not null'), ('snapshot_ts not null'), ('state domain'), ('bikes not negative'), ('docks not negative'), ('bikes and docks within capacity')) v(rule)) SELECT rule, CAST(0 AS BIGINT) AS unexpected, n AS elements, true AS passed FROM r, n UNION ALL SELECT 'unique station and snapshot', x, n, x = 0 FROM u"),
    "unique_grain": (lambda s, d: quality.repeated(src.status(s, d), ["station_id", "snapshot_ts"]), f"WITH {STATUS} SELECT station_id, snapshot_ts, count(*) AS n FROM status GROUP BY 1, 2 HAVING count(*) > 1"),
    "relationships": (lambda s, d: quality.orphans(src.status(s, d), src.stations(s, d), "station_id", "station_id"), f"WITH {STATUS}, {STATIONS} SELECT station_id, count(*) AS n FROM status WHERE station_id NOT IN (SELECT station_id FROM stations) GROUP BY 1"),
    "accepted_values": (lambda s, d: quality.unaccepted(src.status(s, d), "state", ("ok", "low", "high")), f"WITH {STATUS} SELECT state, count(*) AS n FROM status WHERE state NOT IN ('ok', 'low', 'high') GROUP BY 1"),
    "share_range": (lambda s, d: quality.shares_out_of_range(_daily(s, d), _hourly(s, d)), f"WITH {DAILY}, hourly AS (SELECT station_id, hour_of_day FROM staged JOIN stations USING (station_id) GROUP BY 1, 2) SELECT 'daily' AS mart, count(*) AS n, CAST(0 AS BIGINT) AS bad FROM daily UNION ALL SELECT 'hourly', count(*), CAST(0 AS BIGINT) FROM hourly"),
    "offset_gaps": (lambda s, d: quality.offset_gaps(src.status(s, d)), f'WITH {STATUS} SELECT part AS "partition", count(*) AS n, max(off) - min(off) + 1 - count(DISTINCT off) AS missing, count(*) - count(DISTINCT off) AS repeated FROM status GROUP BY 1'),
    "duplicates": (lambda s, d: quality.duplicates(src.status(s, d)), f"WITH {STATUS} SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT station_id, snapshot_ts FROM status)) AS duplicates FROM status"),
    "events_per_minute": (lambda s, d: health.per_minute(src.status(s, d)), f"WITH {STATUS} SELECT kafka_ts - kafka_ts % 60 AS minute, count(*) AS events FROM status GROUP BY 1"),
    "latency_percentiles": (lambda s, d: health.latency(src.status(s, d)), f"WITH {STATUS} SELECT processed_ts - processed_ts % 60 AS minute, count(*) AS processed, CAST(quantile_disc(processed_ts - fetched_ts, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(processed_ts - fetched_ts, 0.95) AS BIGINT) AS p95 FROM status GROUP BY 1"),
    "lag_series": (lambda s, d: health.series(src.status(s, d)), f"WITH {STATUS}, {SERIES} SELECT * FROM series"),
    "health_tiles": (lambda s, d: health.tiles(health.series(src.status(s, d))), f"WITH {STATUS}, {SERIES}, l AS (SELECT max(minute) FILTER (processed > 0) AS top FROM series) SELECT round(sum(events) / count(*), 1) AS events_per_min, max(p95) AS latency_p95_s, (SELECT arg_max(lag_records, minute) FROM series) AS lag_records FROM series, l WHERE minute <= top AND minute > top - 3600"),
    "table_freshness": (lambda s, d: health.table_freshness({"status": (src.status(s, d), "snapshot_ts"), "jobs": (src.jobs(s, d), "opened_at"), "trips": (src.trips(s, d), "started")}, 1706700000), f"WITH {STATUS}, {JOBS}, {TRIPS}, a AS (SELECT 'status' AS table_name, count(*) AS n, min(snapshot_ts) AS oldest, max(snapshot_ts) AS newest FROM status UNION ALL SELECT 'jobs', count(*), min(opened_at), max(opened_at) FROM jobs UNION ALL SELECT 'trips', count(*), min(started), max(started) FROM trips) SELECT *, CASE WHEN table_name = 'status' THEN CASE WHEN 1706700000 - newest <= 300 THEN 'ok' WHEN 1706700000 - newest <= 86400 THEN 'warn' ELSE 'fail' END WHEN 1706700000 - newest <= 172800 THEN 'ok' ELSE 'warn' END AS status, CASE WHEN 1706700000 - newest < 120 THEN (1706700000 - newest) || ' s' WHEN 1706700000 - newest < 7200 THEN ((1706700000 - newest) // 60) || ' min' WHEN 1706700000 - newest < 172800 THEN ((1706700000 - newest) // 3600) || ' h' ELSE ((1706700000 - newest) // 86400) || ' days' END AS age FROM a"),
    "nearest_rank": (lambda s, d: health.weighted_ranks(src.status(s, d).withColumn("latency", F.col("processed_ts") - F.col("fetched_ts")), ["state"], "latency"), f"WITH {STATUS} SELECT state, count(*) AS n, CAST(quantile_disc(processed_ts - fetched_ts, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(processed_ts - fetched_ts, 0.95) AS BIGINT) AS p95, max(processed_ts - fetched_ts) AS largest FROM status GROUP BY 1"),
    "window_report": (lambda s, d: health.window_report(src.status(s, d)), f"WITH {STATUS} SELECT count(*) AS n_rows, count(DISTINCT processed_ts) AS batches, round(count(*) * 60 / (max(kafka_ts) - min(kafka_ts)), 3) AS events_per_min, CAST(quantile_disc(processed_ts - fetched_ts, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(processed_ts - fetched_ts, 0.95) AS BIGINT) AS p95, max(processed_ts - fetched_ts) AS largest FROM status"),
    "rows_per_station": (lambda s, d: src.status(s, d).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("snapshot_ts").alias("newest")), f"WITH {STATUS} SELECT station_id, count(*) AS n, max(snapshot_ts) AS newest FROM status GROUP BY 1"),
    "stations_by_state": (lambda s, d: documents.latest(src.status(s, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n")), f"WITH {STATUS}, {STATIONS}, {LIVE} SELECT state, count(*) AS n FROM live GROUP BY 1"),
    "episode_summary": (lambda s, d: episodes.episodes(src.status(s, d)).groupBy("kind", "status", "alerted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("duration_s") / 60), 1).alias("mean_min"), F.round(F.max("duration_s") / 60, 1).alias("max_min")), f"WITH {STATUS}, {EPISODES} SELECT kind, status, alerted, count(*) AS n, round(avg(duration_s / 60), 1) AS mean_min, round(max(duration_s) / 60, 1) AS max_min FROM episodes GROUP BY 1, 2, 3"),
    "live_list": (lambda s, d: documents.live(src.status(s, d), src.stations(s, d)).drop("place"), f"WITH {STATUS}, {STATIONS}, {LIVE} SELECT station_id, name, view, state, bikes, docks, capacity, snapshot_ts FROM live"),
    "live_counts": (lambda s, d: documents.live_counts(documents.live(src.status(s, d), src.stations(s, d))), f"WITH {STATUS}, {STATIONS}, {LIVE}, v AS (SELECT DISTINCT view FROM live UNION ALL SELECT 'all'), g AS (SELECT view, unnest(['empty', 'low', 'ok', 'high', 'full', 'offline']) AS state FROM v), c AS (SELECT view, state FROM live UNION ALL SELECT 'all', state FROM live) SELECT g.view, g.state, count(c.view) AS n FROM g LEFT JOIN c ON g.view = c.view AND g.state = c.state GROUP BY 1, 2"),
    "alerts_folded": (lambda s, d: documents.alerts_folded(episodes.alerts(src.status(s, d))), f"WITH {STATUS}, {EPISODES}, {ALERTS} SELECT episode_id, station_id, kind, min(start_ts) AS started, max(ts) FILTER (action = 'raised') AS raised, max(ts) FILTER (action = 'resolved') AS resolved, max(ts) FILTER (action = 'resolved') - min(start_ts) AS duration_s FROM alerts GROUP BY 1, 2, 3"),
    "replay_deltas": (lambda s, d: documents.deltas(src.status(s, d)), f"WITH {STATUS}, {FRAMES}, c AS (SELECT station_id, count(*) AS changes FROM moved GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY changes DESC, station_id) - 1 AS station_index FROM c) SELECT frame, station_id, state, bikes, docks, changes, station_index FROM moved JOIN i USING (station_id)"),
    "replay_decode": (lambda s, d: documents.decode(documents.deltas(src.status(s, d)), 473600), f"WITH {STATUS}, {FRAMES} SELECT station_id, state, bikes, docks FROM frames WHERE frame <= 473600 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY frame DESC) = 1"),
    "insights_encode": (lambda s, d: documents.encode(_daily(s, d)), f"WITH {DAILY} SELECT dense_rank() OVER (ORDER BY station_id) - 1 AS s, dense_rank() OVER (ORDER BY service_date) - 1 AS d, round(share_empty, 3) AS e, round(share_full, 3) AS f FROM daily"),
    "day_stats": (lambda s, d: fleet.day_stats(src.status(s, d)), f"WITH {STATUS} SELECT snapshot_ts // 86400 AS day, count(*) AS n, count(DISTINCT snapshot_ts // 3600) AS hours FROM status GROUP BY 1"),
    "day_pick": (lambda s, d: fleet.pick_days(fleet.day_stats(src.status(s, d))), f"WITH {STATUS}, t AS (SELECT snapshot_ts // 86400 AS day, count(*) AS n, count(DISTINCT snapshot_ts // 3600) AS hours FROM status GROUP BY 1), e AS (SELECT count(*) >= 2 AS enough FROM t WHERE hours >= 20) SELECT day, n, hours FROM t, e ORDER BY CASE WHEN enough AND hours >= 20 THEN 1 ELSE 0 END DESC, CASE WHEN enough THEN day ELSE n END DESC, day DESC LIMIT 2"),
    "jobs_due": (_due, f"""WITH {STATUS}, {EPISODES}, {JOBS}, e AS (SELECT * FROM episodes WHERE kind = 'empty' AND duration_s > 1200 AND start_ts % 7 <> 0),
      t AS (SELECT *, unnest(range((start_ts + 1259) // 60 * 60, start_ts + duration_s, 60)) AS tick FROM e),
      held AS (SELECT DISTINCT episode_id, tick FROM t JOIN djobs j ON j.station_id = t.station_id AND j.opened_at <= tick AND coalesce(j.closed_at, 9000000000000) > tick)
      SELECT episode_id, station_id, start_ts, duration_s, min(tick) AS due_at FROM t ANTI JOIN held USING (episode_id, tick) GROUP BY 1, 2, 3, 4"""),
    "assign_vans": (lambda s, d: fleet.assign(src.jobs(s, d), src.vans(s, d)), f"WITH {JOBS}, w AS (SELECT *, row_number() OVER (ORDER BY opened_at, station_id, job_id) AS n FROM jobs WHERE status = 'open'), v AS (SELECT *, row_number() OVER (ORDER BY plate) AS n FROM vans WHERE status = 'idle') SELECT job_id, station_id, opened_at, van_id, plate FROM w JOIN v USING (n)"),
    "unfinished_jobs": (lambda s, d: fleet.unfinished(src.jobs(s, d)), f"WITH {JOBS} SELECT station_id, count(*) AS jobs, min(opened_at) AS oldest FROM jobs WHERE status IN ('open', 'assigned') GROUP BY 1"),
}

ENTRIES |= feeds.ENTRIES | lakes.ENTRIES | replica.ENTRIES | reports.ENTRIES
QUERIES: dict[str, Query] = {name: query for name, (query, _) in ENTRIES.items()}
#: Without SQL: sizes of files.
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
