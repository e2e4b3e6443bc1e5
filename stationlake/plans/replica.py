"""Registered queries over the changelog of several tables, and over the outputs of the stateful stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.exprs import row_hash
from stationlake.operators import cdc, digests
from stationlake.operators.tables import Lake
from stationlake.plans.fragments import ALERTS, CHANGES, EPISODES, JOBS, STATIONS, STATUS
from stationlake.sources import adapters as src
from stationlake.streaming import jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]
COUNTED = ["order_id", "line", "quantity", "status"]


def _replicas(s: SparkSession, d: str) -> Lake:
    """All change messages as a stream of files, applied table by table."""
    path = jobs.shared_dir(s)
    src.change_messages(s, d).write.parquet(f"{path}/in")
    lake = Lake(s, f"{path}/lake")
    cdc.replicate(cdc.source(s, f"{path}/in", 1_000_000), lake, f"{path}/checkpoint")
    return lake


def _many(s: SparkSession, d: str) -> DataFrame:
    """What the replicas of three tables hold, by table: rows and a digest."""
    lake, out = _replicas(s, d), None
    for table, columns in (("jobs", ["job_id", "station_id", "status"]), ("lines", COUNTED), ("stations", ["station_id", "station_name"])):
        line = cdc.checksum(lake.rows(table), columns).select(F.lit(table).alias("table_name"), "n", "digest")
        out = line if out is None else out.unionByName(line)
    return out


def _decoded(s: SparkSession, d: str) -> DataFrame:
    """Events of the lines' topic, told from the other topics and typed by their own schemas."""
    events, key = cdc.decoded(src.change_messages(s, d))["lines"]
    return events.select(*key, "quantity", "status", "op", "lsn", "offset")


def _report(s: SparkSession, d: str) -> DataFrame:
    """Jobs as they are against a replica that missed the assigned ones, and stations against their own rows."""
    j, st = src.jobs(s, d).select("job_id", "station_id", "status"), src.stations(s, d).select("station_id", "station_name")
    missed = j.where("status != 'assigned'").withColumn("priority", F.when(F.col("status") == "open", 1))
    return cdc.replica_report({"jobs": j, "stations": st}, {"jobs": missed, "stations": st.withColumn("_lsn", F.lit(1))}, {"jobs": "priority"})


def _evolving(s: SparkSession, d: str) -> DataFrame:
    """The replica of the lines after three triggers; their messages have one column more from the second on."""
    path, files = jobs.shared_dir(s), 4
    for part in src.evolving_messages(s, d):
        part.repartition(files).write.mode("append").parquet(f"{path}/in")
    lake = Lake(s, f"{path}/lake")
    cdc.replicate(cdc.source(s, f"{path}/in", files), lake, f"{path}/checkpoint")
    return lake.rows("lines").select("order_id", "line", "quantity", "status", "priority", "lsn")


def _expected(s: SparkSession, d: str) -> DataFrame:
    """Events of each table by operation, against what the tables themselves say."""
    log = src.changelog(s, d)
    events = log.select(F.lit("lines").alias("table_name"), "op").unionByName(src.jobs(s, d).select(F.lit("jobs").alias("table_name"), F.lit("c").alias("op")))
    want = events.where("op != 'r'").groupBy("table_name", "op").agg(F.count_if(F.col("op") != "d").alias("n"))
    return cdc.expected_counts(events, want)


def _tables(s: SparkSession, d: str) -> Lake:
    """The three outputs of the stateful stream, as they are in the lake after all triggers."""
    path = jobs.shared_dir(s)
    lake = Lake(s, f"{path}/lake")
    sinks.run(jobs.source(s, *jobs.as_files(src.status(s, d))), lake, f"{path}/checkpoint")
    return lake


def _state(s: SparkSession, d: str) -> DataFrame:
    rows = _tables(s, d).rows("latest_state").withColumn("p", F.from_json("payload", sinks.PAYLOADS["state"]))
    return rows.select("p.station_id", "p.snapshot_ts", "p.state", "p.bikes", "p.docks", "p.open_kind", "p.open_start_ts")


def _alerts(s: SparkSession, d: str) -> DataFrame:
    return _tables(s, d).rows("alerts").select("alert_id", "episode_id", "station_id", "kind", "action", "start_ts", "duration_s", "ts")


def _episodes(s: SparkSession, d: str) -> DataFrame:
    return _tables(s, d).rows("station_episodes").select("episode_id", "station_id", "kind", "start_ts", "end_ts", "duration_s", "status", "alerted")


def _odd_double():
    """Doubles whose text is no plain decimal everywhere, and quotients."""
    odd = {0: "NaN", 1: "-0.0", 2: "1e-5", 3: "1e16", 4: "-Infinity", 5: "0.0001", 6: "1234567890123456"}
    out = F.col("job_id") / 7.0
    for k, text in odd.items():
        out = F.when(F.col("job_id") % 8 == k, F.lit(text).cast("double")).otherwise(out)
    return out


DIGEST = "CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(31), {0})), 1, 15)) AS BIGINT)) % 1152921504606846976 AS BIGINT)"
HASH = "sha256(concat_ws(chr(31), order_id, line, lsn, op, quantity))"

#: A tree over the rows' hashes: leaves of four hex digits, each row's hash with its count.
TREE = """h AS (SELECT {0} AS h, count(*) AS c FROM {1} GROUP BY 1), l4 AS (SELECT substr(h, 1, 4) AS p, sum(c) AS n, sha256(string_agg(h || ':' || c, chr(10) ORDER BY h || ':' || c)) AS d FROM h GROUP BY 1),
  """ + ",\n  ".join(f"l{k} AS (SELECT substr(p, 1, {k}) AS p, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || '=' || d, chr(10) ORDER BY p || '=' || d)) AS d FROM l{k + 1} GROUP BY 1)" for k in (3, 2, 1, 0))

ENTRIES: dict[str, tuple[Query, str]] = {
    "cdc_many_tables": (_many, f"""WITH {CHANGES}, {JOBS}, {STATIONS}, kept AS (SELECT * FROM newest WHERE op <> 'd') SELECT 'lines' AS table_name, count(*) AS n, {DIGEST.format('order_id, line, quantity, status')} AS digest FROM kept UNION ALL SELECT 'jobs', count(*), {DIGEST.format('job_id, station_id, status')} FROM jobs WHERE status <> 'done' UNION ALL SELECT 'stations', count(*), {DIGEST.format('station_id, station_name')} FROM stations"""),
    "cdc_decoded": (_decoded, f'WITH {CHANGES} SELECT order_id, line, quantity, status, op, lsn, off AS "offset" FROM log'),
    "table_digest": (lambda s, d: digests.digest(src.changelog(s, d), ["order_id", "line", "lsn", "op", "quantity"]), f"WITH {CHANGES}, {TREE.format(HASH, 'log')} SELECT n, d AS digest FROM l0"),
    "cdc_evolving": (_evolving, f"WITH {CHANGES}, t AS (SELECT max(lsn) AS top FROM log) SELECT order_id, line, quantity, status, CASE WHEN lsn * 3 // top >= 1 THEN line END AS priority, lsn FROM newest, t WHERE op <> 'd'"),
    "replica_report": (_report, f"""WITH {JOBS}, {STATIONS}, m AS (SELECT * FROM jobs WHERE status <> 'assigned') SELECT 'jobs' AS table_name, (SELECT count(*) FROM jobs) AS source_rows, (SELECT count(*) FROM m) AS replica_rows, '' AS missing_columns, (SELECT count(*) FROM m WHERE status = 'open') AS evolved_rows, false AS equal UNION ALL SELECT 'stations', count(*), count(*), '', CAST(NULL AS BIGINT), true FROM stations"""),
    "cdc_expected": (_expected, f"WITH {CHANGES}, {JOBS}, e AS (SELECT 'lines' AS table_name, op, count(*) AS found FROM log GROUP BY 2 UNION ALL SELECT 'jobs', 'c', count(*) FROM jobs) SELECT table_name, op, found, CASE WHEN op <> 'd' THEN found ELSE 0 END AS expected, op <> 'd' AS ok FROM e"),
    "canonical_hashes": (lambda s, d: src.jobs(s, d).select("job_id", row_hash(F.col("job_id"), F.col("status"), F.when(F.col("status") == "done", F.col("opened_at")), F.col("status") == "open", F.timestamp_seconds("opened_at"), (F.col("opened_at") % 7 / 4).cast("double"), (F.col("opened_at") % 100).cast("decimal(10,2)"), _odd_double()).alias("h")),
      f"""WITH {JOBS} SELECT job_id, sha256(concat_ws(chr(31), job_id, status, CASE WHEN status = 'done' THEN CAST(opened_at AS VARCHAR) ELSE '\\N' END, CASE WHEN status = 'open' THEN 't' ELSE 'f' END, strftime(make_timestamp(opened_at * 1000000), '%Y-%m-%dT%H:%M:%S.%f+00:00'), CAST(opened_at % 7 / 4 AS VARCHAR), opened_at % 100,
        CASE job_id % 8 WHEN 0 THEN 'nan' WHEN 1 THEN '-0.0' WHEN 2 THEN '1e-05' WHEN 3 THEN '1e+16' WHEN 4 THEN '-inf' WHEN 5 THEN '0.0001' WHEN 6 THEN '1234567890123456.0' ELSE CAST(job_id / 7.0 AS VARCHAR) END)) AS h FROM jobs"""),
    "stream_latest_state": (_state, f"""WITH {STATUS}, {EPISODES}, l AS (SELECT station_id, max(snapshot_ts) AS snapshot_ts FROM status GROUP BY 1), r AS (SELECT station_id, snapshot_ts, arg_min(state, event_id) AS state, arg_min(bikes, event_id) AS bikes, arg_min(docks, event_id) AS docks FROM status GROUP BY 1, 2)
      SELECT station_id, snapshot_ts, r.state, bikes, docks, e.kind AS open_kind, e.start_ts AS open_start_ts FROM l JOIN r USING (station_id, snapshot_ts) LEFT JOIN (SELECT station_id, kind, start_ts FROM episodes WHERE status = 'open') e USING (station_id)"""),
    "stream_alerts": (_alerts, f"WITH {STATUS}, {EPISODES}, {ALERTS} SELECT * FROM alerts"),
    "stream_station_episodes": (_episodes, f"WITH {STATUS}, {EPISODES} SELECT * FROM episodes"),
}
