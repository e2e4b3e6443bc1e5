"""SQL that the registered queries share: the driver's tables as fleet tables, and what is made of them."""

from __future__ import annotations


def local(x: str) -> str:
    return f"((make_timestamp(({x}) * 1000000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')"


STATUS = """status AS (
  SELECT *, CASE WHEN NOT is_renting OR 20 * k > 1800 THEN 'offline' WHEN bikes = 0 THEN 'empty' WHEN docks = 0 THEN 'full'
    WHEN bikes <= 2 OR bikes <= capacity * 0.1 THEN 'low' WHEN docks <= 2 OR docks <= capacity * 0.1 THEN 'high' ELSE 'ok' END AS state
  FROM (SELECT *, 15 - bikes AS docks, 15 + disabled AS capacity, t + 5 AS fetched_ts, t + k % 7 AS kafka_ts, t - t % 60 AS snapshot_ts,
      t - t % 60 - 20 * k AS last_reported_ts, t - t % 60 + 60 + k % 30 AS processed_ts
    FROM (SELECT event_id, CAST(user_id % 30 AS VARCHAR) AS station_id, epoch_us(ts) // 1000000 AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        CAST(floor(value) AS BIGINT) % 16 AS bikes, event_id % 3 AS disabled, NOT (event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50) AS is_renting,
        CAST(event_id % 6 AS INTEGER) AS part, event_id // 6 AS off FROM events)))"""
STATIONS = """stations AS (SELECT CAST(n_nationkey AS VARCHAR) AS station_id, 'N' || n_nationkey AS short_name, n_name AS station_name, CAST(n_regionkey AS VARCHAR) AS region_id, 37.3 + (n_nationkey % 5) / 10 AS lat, -122.5 + (n_nationkey % 7) / 20 AS lon FROM nation)"""
WINDOWS = f"""{STATUS}, w AS (SELECT snapshot_ts - snapshot_ts % 300 AS window_start, station_id, count(*) AS samples, min(bikes) AS min_bikes, avg(bikes) AS avg_bikes, max(bikes) AS max_bikes,
  avg(docks) AS avg_docks, max(capacity) AS capacity, avg(CASE WHEN state = 'empty' THEN 1.0 ELSE 0 END) AS share_empty, avg(CASE WHEN state = 'full' THEN 1.0 ELSE 0 END) AS share_full,
  avg(CASE WHEN state = 'offline' THEN 1.0 ELSE 0 END) AS share_offline, snapshot_ts - snapshot_ts % 300 + 300 AS window_end FROM status GROUP BY ALL)"""
STAGED = f"""{WINDOWS}, staged AS (SELECT *, CAST({local("window_start")} AS DATE) AS service_date, CAST(hour({local("window_start")}) AS INTEGER) AS hour_of_day FROM w)"""
EPISODES = """firsts AS (SELECT station_id, snapshot_ts, arg_min(state, event_id) AS state FROM status GROUP BY ALL),
kinds AS (SELECT station_id, snapshot_ts, CASE WHEN state IN ('empty', 'full') THEN state END AS kind FROM firsts),
marked AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER s THEN 1 ELSE 0 END AS fresh, lead(snapshot_ts) OVER s AS next_ts FROM kinds WINDOW s AS (PARTITION BY station_id ORDER BY snapshot_ts)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY station_id ORDER BY snapshot_ts) AS island FROM marked),
ep AS (SELECT station_id, kind, min(snapshot_ts) AS start_ts, max(snapshot_ts) AS last_ts, arg_max(next_ts, snapshot_ts) FILTER (next_ts IS NOT NULL) AS nx, max(CASE WHEN next_ts IS NULL THEN 1 ELSE 0 END) AS is_open FROM islands WHERE kind IS NOT NULL GROUP BY station_id, island, kind),
episodes AS (SELECT station_id || ':' || kind || ':' || start_ts AS episode_id, station_id, kind, start_ts, CASE WHEN is_open = 0 THEN nx END AS end_ts,
  coalesce(CASE WHEN is_open = 0 THEN nx END, last_ts) - start_ts AS duration_s, CASE WHEN is_open = 1 THEN 'open' ELSE 'closed' END AS status, last_ts - start_ts >= 900 AS alerted FROM ep)"""
ALERTS = """alerts AS (SELECT episode_id || ':' || action AS alert_id, episode_id, station_id, kind, action, start_ts, ts - start_ts AS duration_s, ts FROM (
  SELECT e.episode_id, e.station_id, e.kind, e.start_ts, min(f.snapshot_ts) AS ts, 'raised' AS action FROM episodes e JOIN firsts f ON e.station_id = f.station_id AND f.snapshot_ts - e.start_ts >= 900 WHERE e.alerted GROUP BY ALL
  UNION ALL SELECT episode_id, station_id, kind, start_ts, end_ts, 'resolved' FROM episodes WHERE alerted AND end_ts IS NOT NULL))"""
CLOCK = "(date_trunc('day', l_shipdate) + to_seconds(CAST((l_orderkey * 7919) % 86400 AS BIGINT)))"
LATE = f"(epoch_us({CLOCK} AT TIME ZONE 'America/Los_Angeles') // 1000000)"
TRIPS = f"""trips AS (SELECT 'N' || (l_suppkey % 30) AS start_code, 'N' || (l_partkey % 30) AS end_code, {CLOCK} AS start_clock, CAST(l_quantity * 60 AS BIGINT) AS duration_s,
  CASE WHEN l_returnflag = 'R' THEN 'casual' ELSE 'member' END AS rider, CAST(date_trunc('month', l_shipdate) AS DATE) AS trip_month,
  CASE WHEN {local(LATE + " - 3600")} = {CLOCK} THEN {LATE} - 3600 ELSE {LATE} END AS started FROM lineitem)"""
DAILY = f"""{STAGED}, {STATIONS}, daily AS (SELECT s.station_id, service_date, count(*) AS windows, round(count(*) / 12.0, 6) AS coverage_hours, round(least(greatest(avg(share_empty), 0), 1), 6) AS share_empty,
  round(least(greatest(avg(share_full), 0), 1), 6) AS share_full, round(sum(share_empty) * 5, 6) AS minutes_empty, round(sum(share_full) * 5, 6) AS minutes_full, round(avg(avg_bikes), 6) AS avg_bikes,
  min(window_start) AS first_window, max(window_start) AS last_window, station_name, region_id FROM staged JOIN stations s USING (station_id) GROUP BY ALL)"""
REBALANCING = f"""{STAGED}, {STATIONS}, {EPISODES}, live AS (SELECT max(service_date) AS last_day, CAST(max(service_date) - INTERVAL 7 DAY AS DATE) AS bef, max(window_end) AS last_window FROM staged),
hours AS (SELECT station_id, sum(share_empty) * 5 / 60.0 AS e, sum(share_full) * 5 / 60.0 AS f, count(*) / 12.0 AS c FROM staged, live WHERE service_date > bef GROUP BY station_id),
n AS (SELECT station_id, count(*) AS n, count(*) FILTER (alerted) AS al, max(CASE WHEN kind = 'empty' THEN coalesce(end_ts, last_window) - start_ts END) / 3600.0 AS longest FROM episodes, live WHERE CAST({local("start_ts")} AS DATE) > bef GROUP BY station_id),
rebalancing AS (SELECT h.station_id, station_name, region_id, round(e, 6) AS hours_empty, round(f, 6) AS hours_full, CAST(rank() OVER (ORDER BY round(e + f, 6) DESC) AS BIGINT) AS need_rank, coalesce(n, 0) AS episodes,
  coalesce(al, 0) AS alerted_episodes, round(coalesce(longest, 0.0), 6) AS longest_empty_hours, round(c, 6) AS coverage_hours, CAST(bef + INTERVAL 1 DAY AS DATE) AS window_first_day, last_day AS window_last_day
  FROM hours h JOIN stations s USING (station_id) CROSS JOIN live LEFT JOIN n USING (station_id))"""
HOURLY = f"""{STAGED}, {STATIONS}, {TRIPS}, newest AS (SELECT * FROM trips WHERE trip_month IN (SELECT DISTINCT trip_month FROM trips ORDER BY trip_month DESC LIMIT 12)),
days AS (SELECT CAST(sum(day(last_day(trip_month))) AS BIGINT) AS trip_days, min(trip_month) AS trip_first_month, max(trip_month) AS trip_last_month FROM (SELECT DISTINCT trip_month FROM newest)),
st AS (SELECT station_id, CAST(hour({local("started")}) AS INTEGER) AS hour_of_day, count(*) AS n FROM newest JOIN stations ON start_code = short_name GROUP BY ALL),
en AS (SELECT station_id, CAST(hour({local("started + duration_s")}) AS INTEGER) AS hour_of_day, count(*) AS n FROM newest JOIN stations ON end_code = short_name GROUP BY ALL),
avail AS (SELECT station_id, hour_of_day, round(least(greatest(avg(share_empty), 0), 1), 6) AS share_empty, round(least(greatest(avg(share_full), 0), 1), 6) AS share_full, count(DISTINCT service_date) AS live_days FROM staged GROUP BY ALL),
hourly AS (SELECT a.station_id, station_name, region_id, a.hour_of_day, round(coalesce(st.n, 0) / CAST(trip_days AS DOUBLE), 6) AS trips_started_per_day, round(coalesce(en.n, 0) / CAST(trip_days AS DOUBLE), 6) AS trips_ended_per_day,
  share_empty, share_full, live_days, trip_days, trip_first_month, trip_last_month FROM avail a JOIN stations USING (station_id) CROSS JOIN days LEFT JOIN st ON a.station_id = st.station_id AND a.hour_of_day = st.hour_of_day LEFT JOIN en ON a.station_id = en.station_id AND a.hour_of_day = en.hour_of_day)"""
MEANS = "means AS (SELECT station_id, station_name, CAST((2 * sum(CAST(round(share_empty * 1000000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000 AS mean_share, round(sum(trips_started_per_day), 6) AS trips_per_day FROM hourly GROUP BY ALL)"
CHANGES = """log AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey * 1000 + l_suppkey AS lsn, CAST(round(l_extendedprice * 100) AS BIGINT) AS off, CASE l_returnflag WHEN 'R' THEN 'd' WHEN 'A' THEN 'u' ELSE 'c' END AS op,
  CAST(l_quantity AS BIGINT) AS quantity, l_linestatus AS status FROM lineitem), newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY order_id, line ORDER BY lsn DESC, off DESC) = 1)"""
APPLIED = """half AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY order_id, line, lsn % 2 ORDER BY lsn DESC, off DESC) = 1), a AS (SELECT * FROM half WHERE lsn % 2 = 0 AND op <> 'd'), b AS (SELECT * FROM half WHERE lsn % 2 = 1) SELECT coalesce(a.order_id, b.order_id) AS order_id, coalesce(a.line, b.line) AS line, CASE WHEN b.lsn > coalesce(a.lsn, -1) THEN b.quantity ELSE a.quantity END AS quantity, CASE WHEN b.lsn > coalesce(a.lsn, -1) THEN b.status ELSE a.status END AS status, CASE WHEN b.lsn > coalesce(a.lsn, -1) THEN b.lsn ELSE a.lsn END AS lsn FROM a FULL OUTER JOIN b ON a.order_id = b.order_id AND a.line = b.line WHERE NOT (b.lsn IS NOT NULL AND b.lsn > coalesce(a.lsn, -1) AND b.op = 'd')"""
FRAMES = """frames AS (SELECT snapshot_ts // 3600 AS frame, station_id, state, bikes, docks FROM status QUALIFY row_number() OVER (PARTITION BY snapshot_ts // 3600, station_id ORDER BY snapshot_ts DESC, event_id DESC) = 1),
moved AS (SELECT * FROM (SELECT *, lag(state) OVER s AS a, lag(bikes) OVER s AS b, row_number() OVER s AS r FROM frames WINDOW s AS (PARTITION BY station_id ORDER BY frame)) WHERE r = 1 OR state <> a OR bikes <> b)"""
VIEW = "CASE WHEN region_id = '3' THEN 'sf' WHEN region_id = '5' THEN 'sj' WHEN region_id IN ('12', '13', '14') THEN 'eastbay' WHEN lat < 37.5 THEN 'sj' WHEN lon > -122.36 THEN 'eastbay' ELSE 'sf' END"
LIVE = f"""latest AS (SELECT * FROM status QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY snapshot_ts DESC, event_id DESC) = 1),
live AS (SELECT l.station_id, coalesce(station_name, 'Unknown station') AS name, {VIEW} AS view, state, bikes, docks,
  CASE WHEN s.station_id IS NULL THEN capacity ELSE 15 END AS capacity, snapshot_ts, list_position(['empty', 'low', 'ok', 'high', 'full', 'offline'], state) AS place FROM latest l LEFT JOIN stations s USING (station_id))"""
JOBS = """jobs AS (SELECT o_orderkey AS job_id, CAST(o_custkey % 30 AS VARCHAR) AS station_id, CASE o_orderstatus WHEN 'P' THEN 'open' WHEN 'O' THEN 'assigned' ELSE 'done' END AS status, epoch_us(o_orderdate) // 1000000 AS opened_at, o_orderpriority AS priority FROM orders),
djobs AS (SELECT *, CASE WHEN status = 'done' THEN opened_at + 300 + job_id % 900 END AS closed_at, CASE WHEN status <> 'open' THEN job_id % 40 END AS van_id, CASE WHEN status = 'done' THEN job_id % 20 END AS bikes_moved
  FROM (SELECT job_id, station_id, 1704067200 + (job_id * 7919) % 2678400 AS opened_at, CASE WHEN (job_id * 7919) % 2678400 < 2505600 THEN 'done' ELSE status END AS status FROM jobs)),
vans AS (SELECT s_suppkey AS van_id, s_name AS plate, CASE WHEN s_acctbal > 0 THEN 'idle' ELSE 'busy' END AS status FROM supplier)"""
SERIES = """ends AS (SELECT max(processed_ts - processed_ts % 60) AS m1 FROM status), spine AS (SELECT unnest(range(m1 - 86340, m1 + 60, 60)) AS minute FROM ends),
ev AS (SELECT kafka_ts - kafka_ts % 60 AS minute, count(*) AS n FROM status GROUP BY 1),
pr AS (SELECT processed_ts - processed_ts % 60 AS minute, count(*) AS n, CAST(quantile_disc(processed_ts - fetched_ts, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(processed_ts - fetched_ts, 0.95) AS BIGINT) AS p95 FROM status GROUP BY 1),
series AS (SELECT s.minute, coalesce(ev.n, 0) AS events, coalesce(pr.n, 0) AS processed, p50, p95,
  (SELECT count(*) FROM status WHERE kafka_ts < s.minute + 60) - (SELECT count(*) FROM status WHERE greatest(kafka_ts, processed_ts) < s.minute + 60) AS lag_records FROM spine s LEFT JOIN ev USING (minute) LEFT JOIN pr USING (minute))"""
