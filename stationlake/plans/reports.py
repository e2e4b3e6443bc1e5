"""Registered queries over quality gates, the site's documents, dispatch and upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.exprs import local_date
from stationlake.operators import availability, documents, episodes, fleet, gate, health, marts, quality
from stationlake.plans.fragments import ALERTS, DAILY, EPISODES, FRAMES, HOURLY, JOBS, LIVE, REBALANCING, SERIES, STATIONS, STATUS, VIEW, local
from stationlake.session import ask
from stationlake.sources import adapters as src
from stationlake.streaming.jobs import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
#: A time after all status rows, and a run's name.
NOW, RUN = 1706700000, "run-1"
EXPECTED = ["station_id", "snapshot_ts", "state", "bikes", "docks", "capacity", "processed_ts", "is_installed"]


def _once(s: SparkSession, df: DataFrame) -> DataFrame:
    """df, written to the shared folder, for what reads it more than once."""
    path = f"{shared_dir(s)}/once"
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


def _daily(s: SparkSession, d: str) -> DataFrame:
    return marts.daily(availability.staged(availability.windows(src.status(s, d))), src.stations(s, d))


def _hourly(s: SparkSession, d: str) -> DataFrame:
    return marts.trips_vs_availability(availability.staged(availability.windows(src.status(s, d))), src.trips(s, d), src.stations(s, d))


def _rebalancing(s: SparkSession, d: str) -> DataFrame:
    status = src.status(s, d)
    return marts.rebalancing(availability.staged(availability.windows(status)), episodes.episodes(status), src.stations(s, d))


def _live(s: SparkSession, d: str) -> DataFrame:
    return documents.live(src.status(s, d), src.stations(s, d))


def _violations(s: SparkSession, d: str) -> DataFrame:
    """Shares out of range in both marts, had they been tripled by mistake."""
    wrong = lambda mart: mart.withColumns({c: F.col(c) * 3 for c in ("share_empty", "share_full")})
    return quality.share_violations({"daily": wrong(_daily(s, d)), "hourly": wrong(_hourly(s, d))})


def _results(s: SparkSession, d: str, status: DataFrame | None = None) -> DataFrame:
    """The suite's results; a column is missing, and one rule is not reported."""
    status = src.status(s, d) if status is None else status
    return gate.results(gate.measured(status, EXPECTED, NOW).where("rule != 'docks_not_negative'"))


def _problems(s: SparkSession, d: str, status: DataFrame | None = None) -> DataFrame:
    """Two of three marts, and a daily mart that ends three days before silver."""
    status = src.status(s, d) if status is None else status
    live, stations = _once(s, availability.staged(availability.windows(status))), src.stations(s, d)
    daily, hourly = marts.daily(live, stations), marts.trips_vs_availability(live, src.trips(s, d), stations)
    last = status.agg(local_date(F.max("snapshot_ts")).alias("day"))
    short = daily.join(F.broadcast(last), F.col("service_date") <= F.date_sub("day", 3)).agg(F.max("service_date").alias("day"))
    return gate.mart_problems({"daily": daily, "hourly": hourly.where("live_days < 0")}, short, last)


def _verdict(s: SparkSession, d: str, status: DataFrame | None = None) -> DataFrame:
    tests = gate.ops_rules(src.dispatch_jobs(s, d), src.tickets(s, d), src.stations(s, d)).withColumnRenamed("rule", "name")
    results = _results(s, d, status).withColumn("run", F.lit(RUN))
    return gate.verdict(_problems(s, d, status), tests, results, RUN)


def _lake(s: SparkSession, d: str) -> DataFrame:
    bronze = src.status(s, d)
    last = bronze.agg(F.max("snapshot_ts").alias("top"))
    silver = bronze.join(F.broadcast(last), F.col("snapshot_ts") <= F.col("top") - 600)
    times = bronze.groupBy(F.when(F.col("partition") < 3, "bronze").otherwise("silver").alias("table_name")).agg(F.max("processed_ts").alias("t"))
    commits = times.select("table_name", F.explode(F.array(F.struct(F.col("t").alias("committed_at"), F.lit("append").alias("operation")), F.struct((F.col("t") + 9000).alias("committed_at"), F.lit("replace").alias("operation")))).alias("c")).select("table_name", "c.*")
    return gate.lake_check(bronze, silver, commits, NOW, ("bronze", "silver", "availability"))


def _components(s: SparkSession, d: str) -> DataFrame:
    return health.components(src.status(s, d), _verdict(s, d), src.maintenance_runs(s, d), NOW)


def _health_document(s: SparkSession, d: str) -> DataFrame:
    """The health document as one text, read back: components, tiles, minutes, tables, the gate and the newest compactions.

    Status rows are typed once, and what has two places in the document is made once."""
    status, jobs = _once(s, src.status(s, d)), src.jobs(s, d)
    series, verdict, every = _once(s, health.series(status)), _once(s, _verdict(s, d, status)), _once(s, src.maintenance_runs(s, d))
    runs = health.newest_run(every)
    tables = health.table_freshness({"status": (status, "snapshot_ts"), "jobs": (jobs, "opened_at")}, NOW)
    parts = {"tiles": health.tiles(series), "gate": verdict}
    lists = {"components": (health.components(status, verdict, every, NOW), ["name"]), "minutes": (series, ["minute"]), "tables": (tables, ["table_name"]), "compaction": (runs, ["table_name"])}
    text = documents.nested(parts, lists, {"format": 1, "generated_at": NOW}, most_bytes=1_000_000)
    kinds = {name: part.schema.simpleString() for name, part in parts.items()} | {name: f"array<{rows.schema.simpleString()}>" for name, (rows, _) in lists.items()}
    p = text.select(F.from_json("document", "format int, generated_at long, " + ", ".join(f"{n} {k}" for n, k in kinds.items())).alias("p")).select("p.*")
    told = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    each = F.concat(
        F.array(told("head", F.lit("generated_at"), F.col("generated_at")), told("tiles", F.lit("lag_records"), F.col("tiles.lag_records")), told("gate", F.lit("n_problems"), F.col("gate.n_problems"))),
        F.transform("components", lambda c: told("component", c["name"], c["status"])), F.transform("minutes", lambda m: told("minute", m["minute"], m["events"])),
        F.transform("tables", lambda t: told("table", t["table_name"], t["n"])), F.transform("compaction", lambda r: told("compaction", r["table_name"], r["status"])),
    )
    return p.select(F.explode(each).alias("e")).select("e.*")


def _live_nested(s: SparkSession, d: str) -> DataFrame:
    """The live document as one text, read back: totals and counts by view, and the stations in their order."""
    live = _live(s, d)
    lists = {"totals": (documents.live_totals(live), ["view"]), "counts": (documents.live_counts(live), ["view", "state"]), "stations": (live, ["place", "name", "station_id"])}
    text = documents.nested({}, lists, {"format": 1, "unit": "bikes"}, most_bytes=4_000_000)
    kinds = ", ".join(f"{n} array<{rows.schema.simpleString()}>" for n, (rows, _) in lists.items())
    p = text.select(F.from_json("document", f"format int, unit string, {kinds}").alias("p")).select("p.*")
    told = lambda section, place, name, value: F.struct(F.lit(section).alias("section"), place.cast("long").alias("place"), name.alias("name"), value.cast("string").alias("value"))
    each = F.concat(
        F.transform("totals", lambda t, i: told("total", i + 1, t["view"], t["bikes"])), F.transform("counts", lambda c, i: told("count", i + 1, F.concat_ws("/", c["view"], c["state"]), c["n"])),
        F.transform("stations", lambda x, i: told("station", i + 1, x["station_id"], x["state"])), F.array(told("head", F.lit(0), F.lit("unit"), F.col("unit"))),
    )
    return p.select(F.explode(each).alias("e")).select("e.*")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    """A crash: bronze lost the last tenth of each partition's offsets, and one in 70 is there twice."""
    rows = src.status(s, d)
    ends = rows.groupBy("partition").agg(F.max("offset").alias("last"))
    bronze = rows.join(F.broadcast(ends), "partition").where(F.col("offset") * 10 <= F.col("last") * 9).drop("last")
    twice = bronze.unionByName(bronze.where(F.col("offset") % 70 == 0))
    published = rows.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))
    return health.coverage(twice, rows.dropDuplicates(["station_id", "snapshot_ts"]), published)


def _frames(s: SparkSession, d: str) -> DataFrame:
    return documents.replay_frames(documents.deltas(src.status(s, d))).select("frame", "t", F.array_join(F.col("d").cast("array<string>"), ",").alias("d"))


def _unframed(s: SparkSession, d: str) -> DataFrame:
    moved = documents.deltas(src.status(s, d))
    return documents.unframed(documents.replay_frames(moved), moved.select("station_index", "station_id").distinct(), 473600)


def _labels(s: SparkSession, d: str) -> DataFrame:
    """What people read: each alerted episode's length, its hour, and how fresh it is at the end."""
    e = episodes.episodes(src.status(s, d))
    hour = F.pmod(F.floor(F.col("start_ts") / 3600), F.lit(24)).cast("int")
    return e.select("episode_id", documents.duration_text(F.col("duration_s")).alias("duration"), documents.hour_label(hour).alias("hours"), documents.iso(F.col("start_ts")).alias("started"), documents.freshness_word(F.pmod("duration_s", F.lit(600))).alias("word"))


def _exports(s: SparkSession, d: str) -> DataFrame:
    """The order in which the three marts are exported: each row's place."""
    made = {"daily": (documents.newest_dates(_daily(s, d)), [F.desc("service_date"), "station_id"], "service_date"), "rebalancing": (_rebalancing(s, d), ["need_rank", "station_id"], "need_rank"), "hourly": (_hourly(s, d), ["station_id", "hour_of_day"], "hour_of_day")}
    out = None
    for name, (mart, order, k) in made.items():
        line = documents.in_order(mart, order).select(F.lit(name).alias("mart"), "place", "station_id", F.col(k).cast("string").alias("k"))
        out = line if out is None else out.unionByName(line)
    return out


def _adhoc(s: SparkSession, d: str) -> DataFrame:
    return ask(s, "SELECT state, count(*) AS n, max(bikes) AS most FROM status_rows GROUP BY state ORDER BY state", {"status_rows": src.status(s, d)})


def _median(s: SparkSession, d: str) -> DataFrame:
    runs = src.status(s, d).select(F.col("state").alias("query"), ((F.col("processed_ts") - F.col("fetched_ts")) / 8).alias("seconds"))
    return health.median_run(runs)


RULE_ROWS = """(VALUES (0, 'row_count', 'the newest day has rows', true), (1, 'column_set', 'all expected columns are there', true), (2, 'station_not_null', 'every row has a station', true), (3, 'snapshot_not_null', 'every row has a time', true), (4, 'state_domain', 'every state is a known one', true),
  (5, 'bikes_not_negative', 'no count of bikes is negative', true), (6, 'docks_not_negative', 'no count of docks is negative', true), (7, 'within_capacity', 'bikes and docks are no more than the capacity', true), (8, 'unique', 'one row for each station and time', true), (9, 'fresh', 'the newest row was processed less than five minutes ago', false))"""
RESULTS = f"""newday AS (SELECT * FROM status WHERE snapshot_ts > (SELECT max(snapshot_ts) FROM status) - 86400), dn AS (SELECT count(*) AS n, max(processed_ts) AS p FROM newday),
dup AS (SELECT coalesce(CAST(sum(c) FILTER (c > 1) AS BIGINT), 0) AS x FROM (SELECT count(*) AS c FROM newday GROUP BY station_id, snapshot_ts)),
res AS (SELECT place, rule, label, blocking, CASE rule WHEN 'row_count' THEN n > 0 WHEN 'column_set' THEN false WHEN 'docks_not_negative' THEN false WHEN 'unique' THEN x = 0 WHEN 'fresh' THEN {NOW} - p <= 300 ELSE true END AS success,
  CASE rule WHEN 'row_count' THEN n WHEN 'fresh' THEN {NOW} - p END AS observed, CASE WHEN rule IN ('row_count', 'fresh', 'docks_not_negative') THEN NULL WHEN rule = 'column_set' THEN 1 WHEN rule = 'unique' THEN x ELSE 0 END AS unexpected, CASE WHEN rule <> 'docks_not_negative' THEN n END AS elements
  FROM {RULE_ROWS} v(place, rule, label, blocking), dn, dup), results AS (SELECT place, rule, label, blocking, success, CASE WHEN success THEN 'ok' WHEN blocking THEN 'fail' ELSE 'warn' END AS status, observed, unexpected, elements FROM res)"""
TICKETS = """tickets AS (SELECT l_orderkey * 10 + l_linenumber AS ticket_id, CAST(l_suppkey % 30 AS VARCHAR) AS station_id, CAST(l_partkey % 15 AS INTEGER) AS dock_no, CASE WHEN l_partkey % 3 = 0 THEN 'open' ELSE 'closed' END AS status, epoch_us(l_shipdate) // 1000000 AS opened_at,
  CASE WHEN l_partkey % 3 <> 0 THEN epoch_us(l_shipdate) // 1000000 + CAST(l_quantity AS BIGINT) * 3600 END AS closed_at FROM lineitem)"""
OPS = f"""ops AS (SELECT 'job status' AS rule, count(*) FILTER (status NOT IN ('open', 'assigned', 'done', 'cancelled')) AS n FROM djobs UNION ALL SELECT 'job assigned has van', count(*) FILTER (status = 'assigned' AND van_id IS NULL) FROM djobs UNION ALL SELECT 'job done has bikes', count(*) FILTER (status = 'done' AND bikes_moved IS NULL) FROM djobs
  UNION ALL SELECT 'job bikes in range', count(*) FILTER (bikes_moved NOT BETWEEN 0 AND 60) FROM djobs UNION ALL SELECT 'job closed iff finished', count(*) FILTER ((closed_at IS NOT NULL) <> (status IN ('done', 'cancelled'))) FROM djobs UNION ALL SELECT 'job closes after opening', count(*) FILTER (closed_at < opened_at) FROM djobs
  UNION ALL SELECT 'ticket status', count(*) FILTER (status NOT IN ('open', 'closed')) FROM tickets UNION ALL SELECT 'ticket dock number', count(*) FILTER (dock_no < 1) FROM tickets UNION ALL SELECT 'ticket closed iff finished', count(*) FILTER ((closed_at IS NOT NULL) <> (status = 'closed')) FROM tickets
  UNION ALL SELECT 'ticket closes after opening', count(*) FILTER (closed_at < opened_at) FROM tickets UNION ALL SELECT 'job of unknown station', count(*) FROM djobs WHERE station_id NOT IN (SELECT station_id FROM stations) UNION ALL SELECT 'ticket of unknown station', count(*) FROM tickets WHERE station_id NOT IN (SELECT station_id FROM stations)
  UNION ALL SELECT 'one open ticket a dock', count(*) FROM (SELECT 1 FROM tickets WHERE status = 'open' GROUP BY station_id, dock_no HAVING count(*) > 1))"""
LAST = f"""lastday AS (SELECT CAST({local("(SELECT max(snapshot_ts) FROM status)")} AS DATE) AS day), shortday AS (SELECT max(service_date) AS day FROM daily WHERE service_date <= (SELECT day FROM lastday) - INTERVAL 3 DAY),
problems AS (SELECT 'hourly: no rows' AS problem UNION ALL SELECT 'daily mart ends ' || coalesce(CAST(s.day AS VARCHAR), 'nowhere') || ', silver reaches ' || l.day FROM shortday s, lastday l WHERE s.day IS NULL OR s.day < l.day - INTERVAL 1 DAY)"""
VERDICT = f"""every AS (SELECT problem FROM problems UNION ALL SELECT 'test ' || rule || ': ' || n FROM ops WHERE n > 0 UNION ALL SELECT 'expectation ' || rule || ': ' || coalesce(unexpected || ' unexpected rows', CAST(observed AS VARCHAR), 'not reported') FROM results WHERE status = 'fail'),
verdict AS (SELECT (SELECT string_agg(problem, '; ' ORDER BY problem) FROM every) AS problems, (SELECT count(*) FROM every) AS n_problems, count(*) FILTER (status = 'ok') AS rules_passed, count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'fail') AS rules_failed, (SELECT count(*) FROM every) = 0 AS passed FROM results)"""
RUNS = """runs AS (SELECT 'run-' || day AS run_id, lower(r_name) AS table_name, CASE WHEN (day + r_regionkey) % 11 = 0 THEN 'error' ELSE 'ok' END AS status, day * 86400 + 90000 + r_regionkey * 60 AS finished_at FROM (SELECT DISTINCT snapshot_ts // 86400 AS day FROM status), region),
lastrun AS (SELECT * FROM runs WHERE run_id = (SELECT arg_max(run_id, finished_at) FROM runs))"""
COMPONENTS = f"""st AS (SELECT {NOW} - max(processed_ts) AS a FROM status), mt AS (SELECT count(*) AS n, count(*) FILTER (status = 'error') AS bad, {NOW} - max(finished_at) AS a FROM lastrun),
comp AS (SELECT 'stream' AS name, CASE WHEN a <= 300 THEN 'ok' WHEN a <= 86400 THEN 'warn' ELSE 'fail' END AS status, 'age_s=' || a AS detail FROM st
  UNION ALL SELECT 'quality', CASE WHEN passed THEN 'ok' ELSE 'fail' END, 'rules=' || (rules_passed + rules_failed) || ' failed=' || rules_failed || coalesce(' problems=' || nullif(left(problems, 300), ''), '') FROM verdict
  UNION ALL SELECT 'maintenance', CASE WHEN bad > 0 THEN 'fail' WHEN a <= 172800 THEN 'ok' ELSE 'warn' END, 'tables=' || n || ' failed=' || bad || ' age_s=' || a FROM mt),
components AS (SELECT * FROM comp UNION ALL SELECT 'overall', CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warn') > 0 THEN 'warn' ELSE 'ok' END, '' FROM comp)"""
ISO = "strftime(make_timestamp(({0}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
STATE_AT = "list_position(['empty', 'low', 'ok', 'high', 'full', 'offline'], state) - 1"
PAD = "CAST(station_id AS INTEGER)"
HOUR12 = "CAST(({0} + 11) % 12 + 1 AS VARCHAR) || CASE WHEN {0} % 24 < 12 THEN ' AM' ELSE ' PM' END"

ENTRIES: dict[str, tuple[Query, str]] = {
    "expectation_results": (_results, f"WITH {STATUS}, {RESULTS} SELECT * FROM results"),
    "ops_constraints": (lambda s, d: gate.ops_rules(src.dispatch_jobs(s, d), src.tickets(s, d), src.stations(s, d)), f"WITH {JOBS}, {STATIONS}, {TICKETS}, {OPS} SELECT * FROM ops"),
    "mart_problems": (_problems, f"WITH {DAILY}, {LAST} SELECT * FROM problems"),
    "quality_gate": (_verdict, f"WITH {DAILY}, {JOBS}, {TICKETS}, {OPS}, {LAST}, {RESULTS}, {VERDICT} SELECT * FROM verdict"),
    "health_components": (_components, f"WITH {DAILY}, {JOBS}, {TICKETS}, {OPS}, {LAST}, {RESULTS}, {VERDICT}, {RUNS}, {COMPONENTS} SELECT * FROM components"),
    "health_document": (_health_document, f"""WITH {DAILY}, {JOBS}, {TICKETS}, {OPS}, {LAST}, {RESULTS}, {VERDICT}, {RUNS}, {COMPONENTS}, {SERIES} SELECT 'head' AS section, 'generated_at' AS name, '{NOW}' AS value UNION ALL SELECT 'tiles', 'lag_records', CAST(arg_max(lag_records, minute) AS VARCHAR) FROM series
      UNION ALL SELECT 'gate', 'n_problems', CAST(n_problems AS VARCHAR) FROM verdict UNION ALL SELECT 'component', name, status FROM components UNION ALL SELECT 'minute', CAST(minute AS VARCHAR), CAST(events AS VARCHAR) FROM series
      UNION ALL SELECT 'table', 'status', CAST(count(*) AS VARCHAR) FROM status UNION ALL SELECT 'table', 'jobs', CAST(count(*) AS VARCHAR) FROM jobs UNION ALL SELECT 'compaction', table_name, status FROM lastrun"""),
    "live_document_nested": (_live_nested, f"""WITH {STATUS}, {STATIONS}, {LIVE}, b AS (SELECT * FROM live UNION ALL SELECT * REPLACE ('all' AS view) FROM live), v AS (SELECT DISTINCT view FROM b), g AS (SELECT view, unnest(['empty', 'low', 'ok', 'high', 'full', 'offline']) AS state FROM v), c AS (SELECT g.view, g.state, count(b.view) AS n FROM g LEFT JOIN b ON g.view = b.view AND g.state = b.state GROUP BY 1, 2)
      SELECT 'total' AS section, row_number() OVER (ORDER BY view) AS place, view AS name, CAST(sum(bikes) AS VARCHAR) AS value FROM b GROUP BY view UNION ALL SELECT 'count', row_number() OVER (ORDER BY view, state), view || '/' || state, CAST(n AS VARCHAR) FROM c
      UNION ALL SELECT 'station', row_number() OVER (ORDER BY place, name, station_id), station_id, state FROM live UNION ALL SELECT 'head', 0, 'unit', 'bikes'"""),
    "mart_exports": (_exports, f"""SELECT * FROM (WITH {DAILY} SELECT 'daily' AS mart, row_number() OVER (ORDER BY service_date DESC, station_id) AS place, station_id, CAST(service_date AS VARCHAR) AS k FROM daily WHERE service_date > (SELECT max(service_date) FROM daily) - INTERVAL 30 DAY)
      UNION ALL SELECT * FROM (WITH {REBALANCING} SELECT 'rebalancing', row_number() OVER (ORDER BY need_rank, station_id), station_id, CAST(need_rank AS VARCHAR) FROM rebalancing) UNION ALL SELECT * FROM (WITH {HOURLY} SELECT 'hourly', row_number() OVER (ORDER BY station_id, hour_of_day), station_id, CAST(hour_of_day AS VARCHAR) FROM hourly)"""),
    "maintenance_newest_run": (lambda s, d: health.newest_run(src.maintenance_runs(s, d)), f"WITH {STATUS}, {RUNS} SELECT * FROM lastrun"),
    "lake_check": (_lake, f"""WITH {STATUS}, top AS (SELECT max(snapshot_ts) AS t FROM status), silver AS (SELECT * FROM status WHERE snapshot_ts <= (SELECT t - 600 FROM top)), bp AS (SELECT part, count(*) AS n, count(DISTINCT off) AS d, max(off) - min(off) + 1 AS span FROM status GROUP BY 1),
      m AS (SELECT (SELECT t FROM top) - max(snapshot_ts) AS late, count(*) - count(DISTINCT (station_id, snapshot_ts)) AS twice FROM silver), c AS (SELECT CASE WHEN part < 3 THEN 'bronze' ELSE 'silver' END AS t, {NOW} - max(processed_ts) AS a FROM status GROUP BY 1)
      SELECT 'silver repeats' AS "check", twice AS found, twice = 0 AS passed FROM m UNION ALL SELECT 'offsets repeated', CAST(sum(n - d) AS BIGINT), sum(n - d) = 0 FROM bp UNION ALL SELECT 'offsets missing', CAST(sum(span - d) AS BIGINT), sum(span - d) = 0 FROM bp
      UNION ALL SELECT 'partitions', count(*), count(*) = 6 FROM bp UNION ALL SELECT 'silver behind', late, late <= 300 FROM m UNION ALL SELECT 'commit age ' || t, a, a <= 3600 FROM c UNION ALL SELECT 'commit age availability', NULL, false"""),
    "share_violations": (lambda s, d: _violations(s, d), f"SELECT * FROM (WITH {DAILY} SELECT 'daily' AS mart, station_id, share_empty * 3 AS share_empty, share_full * 3 AS share_full FROM daily) WHERE share_empty > 1 OR share_full > 1 UNION ALL SELECT * FROM (WITH {HOURLY} SELECT 'hourly' AS mart, station_id, share_empty * 3 AS share_empty, share_full * 3 AS share_full FROM hourly) WHERE share_empty > 1 OR share_full > 1"),
    "hour_range": (lambda s, d: _hourly(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("hour_of_day").between(0, 23)).alias("bad"), F.count_distinct("station_id", "hour_of_day").alias("keys")), f"WITH {HOURLY} SELECT count(*) AS n, count(*) FILTER (hour_of_day NOT BETWEEN 0 AND 23) AS bad, count(DISTINCT (station_id, hour_of_day)) AS keys FROM hourly"),
    "crash_coverage": (_coverage, f"WITH {STATUS}, m AS (SELECT part, max(off) AS hi FROM status GROUP BY 1), x AS (SELECT part, count(*) FILTER (off * 10 <= hi * 9 AND off % 70 = 0) AS again, max(hi) AS hi, max(off) FILTER (off * 10 <= hi * 9) AS held FROM status JOIN m USING (part) GROUP BY 1) SELECT CAST(sum(again) AS BIGINT) AS duplicates, CAST(sum(hi - held) AS BIGINT) AS missing, sum(again) = 0 AND sum(hi - held) = 0 AS zero_loss FROM x"),
    "timed_median": (_median, f"WITH {STATUS} SELECT state AS query, median((processed_ts - fetched_ts) / 8) AS median_s, min((processed_ts - fetched_ts) / 8) AS least_s, max((processed_ts - fetched_ts) / 8) AS most_s, count(*) AS runs FROM status GROUP BY 1"),
    "busiest_partition": (lambda s, d: fleet.busiest_partition(src.table_files(s, d)), f"WITH {STATUS}, f AS (SELECT 'status' AS table_name, CAST(snapshot_ts // 86400 AS VARCHAR) AS p, CAST(snapshot_ts // 600 AS VARCHAR) AS file FROM status UNION SELECT 'trips', strftime(l_shipdate, '%Y-%m'), strftime(l_shipdate, '%Y-%m-%d') FROM lineitem), n AS (SELECT table_name, p, count(*) AS files FROM f GROUP BY 1, 2 HAVING count(*) > 1) SELECT table_name, files, p AS \"partition\" FROM n QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY files DESC, p) = 1"),
    "open_tickets": (lambda s, d: fleet.open_tickets(src.tickets(s, d)), f"WITH {TICKETS} SELECT station_id, dock_no, count(*) AS tickets, arg_min(ticket_id, (opened_at, ticket_id)) AS oldest_ticket, min(opened_at) AS oldest, (SELECT max(opened_at) FROM tickets) - min(opened_at) AS open_s FROM tickets WHERE status = 'open' GROUP BY 1, 2"),
    "station_docks": (lambda s, d: fleet.docks(src.stations(s, d)), f"WITH {STATIONS} SELECT station_id, CAST(k AS INTEGER) AS dock_no, station_id || '-' || k AS dock_id FROM stations, range(1, 16) r(k)"),
    "adhoc_sql": (_adhoc, f"WITH {STATUS} SELECT state, count(*) AS n, max(bikes) AS most FROM status GROUP BY 1"),
    "alerts_document": (lambda s, d: documents.alerts_lists(episodes.alerts(src.status(s, d)), src.stations(s, d)), f"""WITH {STATUS}, {STATIONS}, {EPISODES}, {ALERTS}, f AS (SELECT episode_id, station_id, kind, min(start_ts) AS a, max(ts) FILTER (action = 'raised') AS r, max(ts) FILTER (action = 'resolved') AS z FROM alerts GROUP BY 1, 2, 3),
      l AS (SELECT *, CASE WHEN z IS NULL THEN 'open' ELSE 'resolved' END AS list, row_number() OVER (PARTITION BY z IS NULL ORDER BY CASE WHEN z IS NULL THEN a ELSE -z END, episode_id) AS place FROM f)
      SELECT list, place, episode_id, station_id, kind, coalesce(station_name, 'Unknown station') AS name, short_name AS code, {VIEW} AS view, {ISO.format('a')} AS started, {ISO.format('r')} AS raised, {ISO.format('z')} AS resolved, z - a AS duration_s FROM l LEFT JOIN stations USING (station_id) WHERE list = 'open' OR place <= 20"""),
    "live_totals": (lambda s, d: documents.live_totals(_live(s, d)), f"WITH {STATUS}, {STATIONS}, {LIVE}, b AS (SELECT * FROM live UNION ALL SELECT * REPLACE ('all' AS view) FROM live) SELECT view, count(*) AS stations, CAST(sum(bikes) AS BIGINT) AS bikes, count(*) FILTER (state <> 'ok') AS problems, {ISO.format('max(snapshot_ts)')} AS data_as_of FROM b GROUP BY 1"),
    "live_problems": (lambda s, d: documents.filtered(_live(s, d), "eastbay", True).drop("place"), f"WITH {STATUS}, {STATIONS}, {LIVE} SELECT * EXCLUDE (place) FROM live WHERE view = 'eastbay' AND state <> 'ok'"),
    "sorted_list": (lambda s, d: documents.sorted_list(_live(s, d).drop("place").join(src.stations(s, d).select("station_id", "short_name"), "station_id", "left"), "short_name", True).select("station_id", "short_name", "place"), f"WITH {STATUS}, {STATIONS}, {LIVE} SELECT station_id, short_name, row_number() OVER (ORDER BY CASE WHEN short_name IS NULL THEN 1 ELSE 0 END, CAST(substr(short_name, 2) AS INTEGER) DESC, {PAD}) AS place FROM live LEFT JOIN (SELECT station_id, short_name FROM stations) USING (station_id)"),
    "replay_frames": (_frames, f"""WITH {STATUS}, {FRAMES}, c AS (SELECT station_id, count(*) AS changes FROM moved GROUP BY 1), i AS (SELECT station_id, row_number() OVER (ORDER BY changes DESC, station_id) - 1 AS k FROM c)
      SELECT frame, {ISO.format('frame * 3600')} AS t, string_agg(k || ',' || ({STATE_AT}) || ',' || bikes || ',' || docks, ',' ORDER BY k) AS d FROM moved JOIN i USING (station_id) GROUP BY 1"""),
    "replay_unframed": (_unframed, f"WITH {STATUS}, {FRAMES} SELECT station_id, state, bikes, docks FROM frames WHERE frame <= 473600 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY frame DESC) = 1"),
    "daily_newest": (lambda s, d: documents.newest_dates(_daily(s, d), 10).orderBy(F.desc("service_date"), "station_id"), f"WITH {DAILY} SELECT * FROM daily WHERE service_date > (SELECT max(service_date) FROM daily) - INTERVAL 10 DAY"),
    "mart_header": (lambda s, d: documents.header(_rebalancing(s, d), ["window_first_day", "window_last_day"]), f"WITH {REBALANCING} SELECT CAST(max(window_first_day) AS VARCHAR) AS window_first_day, CAST(max(window_last_day) AS VARCHAR) AS window_last_day FROM rebalancing"),
    "mart_packed": (lambda s, d: documents.packed(_daily(s, d).drop("share_empty", "share_full", "minutes_empty", "minutes_full", "avg_bikes", "coverage_hours"), []), f"WITH {DAILY} SELECT dense_rank() OVER (ORDER BY station_id) - 1 AS station, dense_rank() OVER (ORDER BY service_date) - 1 AS day, windows, first_window, last_window FROM daily"),
    "mart_windows": (lambda s, d: documents.mart_windows(_daily(s, d), _rebalancing(s, d), _hourly(s, d)), f"SELECT * FROM (WITH {DAILY} SELECT 'daily' AS mart, count(*) AS n, CAST(min(service_date) AS VARCHAR) AS first, CAST(max(service_date) AS VARCHAR) AS last FROM daily) UNION ALL SELECT * FROM (WITH {REBALANCING} SELECT 'rebalancing', count(*), CAST(min(window_first_day) AS VARCHAR), CAST(max(window_last_day) AS VARCHAR) FROM rebalancing) UNION ALL SELECT * FROM (WITH {HOURLY} SELECT 'hourly', count(*), CAST(min(trip_first_month) AS VARCHAR), CAST(max(trip_last_month) AS VARCHAR) FROM hourly)"),
    "reading_labels": (_labels, f"""WITH {STATUS}, {EPISODES}, h AS (SELECT *, CAST(start_ts // 3600 % 24 AS INTEGER) AS h, duration_s // 60 AS m FROM episodes) SELECT episode_id, CASE WHEN duration_s < 60 THEN duration_s || ' s' WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' min' ELSE '' END END AS duration,
      {HOUR12.format('h')} || '–' || {HOUR12.format('(h + 1)')} AS hours, {ISO.format('start_ts')} AS started, CASE WHEN duration_s % 600 < 120 THEN 'live' WHEN duration_s % 600 <= 300 THEN 'delayed' ELSE 'paused' END AS word FROM h"""),
}
