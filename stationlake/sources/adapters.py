"""The driver's tables as the tables of a bike-share fleet, by pure expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.exprs import capacity, epoch, local_epoch, station_state, wall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw status messages: key, value (JSON), partition, offset and times, one for each event."""
    e = table(spark, sf_dir, "events")
    t = epoch(F.col("ts"))
    m = t - F.pmod(t, F.lit(60))
    k = F.get_json_object("props", "$.k").cast("long")
    bikes = F.pmod(F.floor("value").cast("long"), F.lit(16))
    body = F.struct(
        F.pmod("user_id", F.lit(30)).cast("string").alias("station_id"), m.alias("last_updated"), (m - 20 * k).alias("last_reported"),
        bikes.alias("num_bikes_available"), (15 - bikes).alias("num_docks_available"), F.pmod("event_id", F.lit(3)).alias("num_bikes_disabled"),
        (~((F.col("event_type") == "error") & (k >= 50))).alias("is_renting"), (t + 5).alias("fetched_at"),
    )
    return e.select(
        F.pmod("user_id", F.lit(30)).cast("string").alias("key"), F.to_json(body).alias("value"), F.pmod("event_id", F.lit(6)).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 6).cast("long").alias("offset"), (t + F.pmod(k, F.lit(7))).alias("kafka_ts"), (m + 60 + F.pmod(k, F.lit(30))).alias("processed_ts"), "event_id",
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver status rows, typed, with capacity and state; all times in epoch seconds."""
    e = table(spark, sf_dir, "events")
    t = epoch(F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("long")
    bikes = F.pmod(F.floor("value").cast("long"), F.lit(16))
    rows = e.select(
        "event_id", F.pmod("user_id", F.lit(30)).cast("string").alias("station_id"), (t - F.pmod(t, F.lit(60))).alias("snapshot_ts"), k.alias("k"),
        bikes.alias("bikes"), (15 - bikes).alias("docks"), F.pmod("event_id", F.lit(3)).alias("disabled"),
        (~((F.col("event_type") == "error") & (k >= 50))).alias("is_renting"), (t + 5).alias("fetched_ts"), (t + F.pmod(k, F.lit(7))).alias("kafka_ts"),
        F.pmod("event_id", F.lit(6)).cast("int").alias("partition"), F.floor(F.col("event_id") / 6).cast("long").alias("offset"),
    )
    rows = rows.withColumns({"last_reported_ts": F.col("snapshot_ts") - 20 * F.col("k"), "processed_ts": F.col("snapshot_ts") + 60 + F.pmod("k", F.lit(30)), "capacity": capacity(F.col("bikes"), F.col("docks"), F.col("disabled"))})
    age = F.col("snapshot_ts") - F.col("last_reported_ts")
    return rows.withColumn("state", station_state(F.col("bikes"), F.col("docks"), F.col("capacity"), F.col("is_renting"), age))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("string").alias("station_id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("short_name"),
        F.col("n_name").alias("station_name"), F.col("n_regionkey").cast("string").alias("region_id"), F.lit(15).alias("capacity"),
        (37.3 + F.pmod("n_nationkey", F.lit(5)) / 10).alias("lat"), (-122.5 + F.pmod("n_nationkey", F.lit(7)) / 20).alias("lon"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with Pacific start clock, epochs, codes and the month they belong to."""
    li = table(spark, sf_dir, "lineitem")
    clock = F.timestamp_add("SECOND", F.pmod(F.col("l_orderkey") * 7919, F.lit(86400)), F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz"))
    code = lambda c: F.concat(F.lit("N"), F.pmod(c, F.lit(30)).cast("string"))
    rows = li.select(
        code("l_suppkey").alias("start_code"), code("l_partkey").alias("end_code"), clock.alias("start_clock"),
        (F.col("l_quantity") * 60).cast("long").alias("duration_s"), F.when(F.col("l_returnflag") == "R", "casual").otherwise("member").alias("rider"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("trip_month"),
    )
    return rows.withColumn("started", local_epoch(F.col("start_clock"))).withColumn("ended", F.col("started") + F.col("duration_s"))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of one replicated table: key (order, line), lsn, offset, op and the row's image."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("lsn"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("offset"), F.when(F.col("l_returnflag") == "R", "d").when(F.col("l_returnflag") == "A", "u").otherwise("c").alias("op"),
        F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linestatus").alias("status"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status_of = F.when(F.col("o_orderstatus") == "P", "open").when(F.col("o_orderstatus") == "O", "assigned").otherwise("done")
    return o.select(F.col("o_orderkey").alias("job_id"), F.pmod("o_custkey", F.lit(30)).cast("string").alias("station_id"), status_of.alias("status"), epoch(F.col("o_orderdate")).alias("opened_at"), F.col("o_orderpriority").alias("priority"))


def vans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("van_id"), F.col("s_name").alias("plate"), F.when(F.col("s_acctbal") > 0, "idle").otherwise("busy").alias("status"))


def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status topic: key, value (JSON of all documented fields), topic, partition, offset, timestamp.

    One message in 301 is broken text, as a producer that died in mid-write leaves it."""
    s = status(spark, sf_dir)
    body = F.struct(
        "station_id", F.col("bikes").alias("num_bikes_available"), F.col("disabled").alias("num_bikes_disabled"), F.col("docks").alias("num_docks_available"),
        F.pmod("event_id", F.lit(2)).alias("num_docks_disabled"), F.floor(F.col("bikes") / 2).alias("num_ebikes_available"), (F.pmod("event_id", F.lit(89)) != 0).alias("is_installed"),
        "is_renting", (F.pmod("event_id", F.lit(83)) != 0).alias("is_returning"), F.col("last_reported_ts").alias("last_reported"), F.col("snapshot_ts").alias("feed_last_updated"),
        F.lit("2.3").alias("feed_version"), (F.col("fetched_ts") + 0.25).alias("fetched_at"), F.concat(F.lit("station_status:"), F.col("snapshot_ts").cast("string")).alias("snapshot_id"),
        F.pmod("event_id", F.lit(4)).alias("num_scooters_available"), F.pmod("event_id", F.lit(5)).alias("num_scooters_unavailable"),
    )
    value = F.when(F.pmod("event_id", F.lit(301)) == 0, F.lit('{"station_id": "')).otherwise(F.to_json(body))
    return s.select(F.col("station_id").alias("key"), value.alias("value"), F.lit("gbfs.station_status").alias("topic"), "partition", "offset", F.col("kafka_ts").alias("timestamp"), "event_id")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the status feed as they are fetched: feed, last_updated, version, fetched_at, and the
    stations of that minute. One row in 211 lacks its id, one in 223 a flag, one in 197 has a negative count; the snapshots of
    midnight have no list."""
    s = status(spark, sf_dir)
    row = F.struct(
        "event_id", F.when(F.pmod("event_id", F.lit(211)) != 0, F.col("station_id")).alias("station_id"),
        F.when(F.pmod("event_id", F.lit(197)) == 0, -1 - F.col("bikes")).otherwise(F.col("bikes")).alias("num_bikes_available"), F.col("docks").alias("num_docks_available"),
        F.when(F.pmod("event_id", F.lit(223)) != 0, 1).alias("is_installed"), F.col("is_renting").cast("int").alias("is_renting"), (F.pmod("event_id", F.lit(83)) != 0).cast("int").alias("is_returning"),
        F.col("last_reported_ts").alias("last_reported"),
    )
    grouped = s.groupBy(F.lit("station_status").alias("feed"), F.col("snapshot_ts").alias("last_updated")).agg(F.array_sort(F.collect_list(row)).alias("stations"), (F.max("fetched_ts") + 0.12345).alias("fetched_at"))
    midnight = F.pmod("last_updated", F.lit(86400)) == 0
    return grouped.select("feed", "last_updated", F.lit("2.3").alias("version"), "fetched_at", F.when(~midnight, F.col("stations")).alias("stations"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the raw archive: one file for each minute's status, one each hour for the station information."""
    t = status(spark, sf_dir).select(F.col("snapshot_ts").alias("t")).distinct()
    day, hour = F.date_format(wall(F.col("t")), "yyyy-MM-dd"), F.date_format(wall(F.col("t")), "HH")
    path = lambda feed: F.concat(F.lit(f"raw/gbfs/{feed}/dt="), day, F.lit("/"), hour, F.lit("/"), F.col("t").cast("string"), F.lit(".json.gz"))
    return t.select(path("station_status").alias("path")).unionByName(t.where(F.pmod("t", F.lit(3600)) == 0).select(path("station_information").alias("path")))


def trip_files(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Trips as the text columns of a month's file in the ``legacy`` or the ``ride`` layout, with odd blanks,
    other cases, unreadable numbers and, for one duration, unreadable times."""
    t = trips(spark, sf_dir)
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    start, end = clock("start_clock"), clock(F.timestamp_add("SECOND", "duration_s", "start_clock"))
    odd = F.pmod("duration_s", F.lit(2820)) == 0
    blank = F.concat(F.lit(" "), "start_code", F.lit(" "))
    no_name, lat, lon = F.lit(""), F.lit("37.77"), F.when(odd, F.lit("n/a")).otherwise(F.lit("-122.41"))
    if layout == "legacy":
        user = F.when(F.col("rider") == "member", "Subscriber").otherwise("Customer")
        cols = {
            "duration_sec": F.col("duration_s").cast("string"), "start_time": F.when(odd, F.lit("soon")).otherwise(start), "end_time": end, "start_station_id": blank,
            "start_station_name": no_name, "start_station_latitude": lat, "start_station_longitude": lon, "end_station_id": F.col("end_code"), "end_station_name": no_name,
            "end_station_latitude": lat, "end_station_longitude": lon, "bike_id": F.pmod("duration_s", F.lit(500)).cast("string"), "user_type": user, "bike_share_for_all_trip": F.lit("No"),
        }
    else:
        cols = {
            "ride_id": F.concat(F.col("start_code"), F.lit("-"), F.col("started").cast("string")), "rideable_type": F.lit("electric_bike"), "started_at": F.when(odd, F.lit("")).otherwise(start),
            "ended_at": end, "start_station_name": no_name, "start_station_id": blank, "end_station_name": no_name, "end_station_id": F.col("end_code"), "start_lat": lat, "start_lng": lon,
            "end_lat": lat, "end_lng": lon, "member_casual": F.upper("rider"),
        }
    return t.select("trip_month", *(v.alias(k) for k, v in cols.items()))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance tickets of docks: two in three are closed."""
    li = table(spark, sf_dir, "lineitem")
    opened = epoch(F.col("l_shipdate"))
    closed = F.when(F.pmod("l_partkey", F.lit(3)) != 0, opened + F.col("l_quantity").cast("long") * 3600)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket_id"), F.pmod("l_suppkey", F.lit(30)).cast("string").alias("station_id"), F.pmod("l_partkey", F.lit(15)).cast("int").alias("dock_no"),
        F.when(closed.isNull(), "open").otherwise("closed").alias("status"), opened.alias("opened_at"), closed.alias("closed_at"),
    )


def _change(columns: dict[str, str], key: list[str], op, lsn, ts_ms, columns_of) -> tuple:
    """Key and value of change messages: envelopes with their schemas."""
    fields = ",".join(f'{{"field":"{n}","type":"{t}"}}' for n, t in columns.items())
    value_schema = f'{{"fields":[{{"field":"before","type":"struct","fields":[{fields}]}},{{"field":"after","type":"struct","fields":[{fields}]}}]}}'
    key_schema = '{"fields":[' + ",".join(f'{{"field":"{k}","type":"{columns[k]}"}}' for k in key) + "]}"
    image = F.to_json(F.struct(*(columns_of[c].alias(c) for c in columns)))
    source = F.to_json(F.struct(lsn.alias("lsn"), ts_ms.alias("ts_ms")))
    before, after = F.when(op == "d", image).otherwise("null"), F.when(op == "d", F.lit("null")).otherwise(image)
    payload = F.concat(F.lit('{"before":'), before, F.lit(',"after":'), after, F.lit(',"op":"'), op, F.lit('","source":'), source, F.lit("}"))
    keys = F.to_json(F.struct(*(columns_of[k].alias(k) for k in key)))
    return F.concat(F.lit(f'{{"schema":{key_schema},"payload":'), keys, F.lit("}")), F.concat(F.lit(f'{{"schema":{value_schema},"payload":'), payload, F.lit("}"))


def change_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change messages of three replicated tables (topic, key, value, offset): lines, jobs and stations. One line in
    50 has a tombstone beside it."""
    log = changelog(spark, sf_dir)
    lines = {"order_id": "int64", "line": "int64", "quantity": "int64", "status": "string"}
    key, value = _change(lines, ["order_id", "line"], F.col("op"), F.col("lsn"), F.col("lsn"), {c: F.col(c) for c in lines})
    tomb = F.pmod(F.col("order_id"), F.lit(50)) == 0
    values = F.when(tomb, F.array(value, F.lit(None).cast("string"))).otherwise(F.array(value))
    out = log.select(F.lit("ops.public.lines").alias("topic"), key.alias("key"), F.explode(values).alias("value"), "offset")
    j = jobs(spark, sf_dir)
    columns = {"job_id": "int64", "station_id": "string", "status": "string"}
    key, value = _change(columns, ["job_id"], F.when(F.col("status") == "done", "d").otherwise("c"), F.col("job_id"), F.col("opened_at") * 1000, {c: F.col(c) for c in columns})
    out = out.unionByName(j.select(F.lit("ops.public.jobs").alias("topic"), key.alias("key"), value.alias("value"), F.col("job_id").cast("long").alias("offset")))
    s = stations(spark, sf_dir).withColumn("n", F.col("station_id").cast("long"))
    columns = {"station_id": "string", "station_name": "string"}
    key, value = _change(columns, ["station_id"], F.lit("r"), F.col("n"), F.col("n"), {c: F.col(c) for c in columns})
    return out.unionByName(s.select(F.lit("ops.public.stations").alias("topic"), key.alias("key"), value.alias("value"), F.col("n").alias("offset")))


def evolving_messages(spark: SparkSession, sf_dir: str, parts: int = 3) -> list[DataFrame]:
    """Change messages of the lines' topic in ``parts`` portions by lsn; from the second on the rows have a priority as well."""
    log = changelog(spark, sf_dir).withColumn("priority", F.col("line").cast("int"))
    old = {"order_id": "int64", "line": "int64", "quantity": "int64", "status": "string"}
    top = log.agg(F.max("lsn").alias("top"))
    placed = log.join(F.broadcast(top)).withColumn("part", F.least(F.lit(parts - 1), F.floor(F.col("lsn") * parts / F.col("top")).cast("int")))
    out = []
    for i in range(parts):
        columns = old if i == 0 else old | {"priority": "int32"}
        key, value = _change(columns, ["order_id", "line"], F.col("op"), F.col("lsn"), F.col("lsn"), {c: F.col(c) for c in columns})
        out.append(placed.where(F.col("part") == i).select(F.lit("ops.public.lines").alias("topic"), key.alias("key"), value.alias("value"), "offset"))
    return out


def dispatch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebalancing jobs of January 2024, the month of the status rows: those opened before its last two days are done, five to
    twenty minutes later; later ones have their own status."""
    j = jobs(spark, sf_dir)
    opened = F.lit(1704067200) + F.pmod(F.col("job_id") * 7919, F.lit(2678400))
    rows = j.select("job_id", "station_id", opened.alias("opened_at"), F.when(opened < 1704067200 + 2505600, "done").otherwise(F.col("status")).alias("status"))
    done = F.col("status") == "done"
    return rows.select(
        "job_id", "station_id", "status", "opened_at", F.when(done, F.col("opened_at") + 300 + F.pmod("job_id", F.lit(900))).alias("closed_at"),
        F.when(F.col("status") != "open", F.pmod("job_id", F.lit(40))).alias("van_id"), F.when(done, F.pmod("job_id", F.lit(20))).alias("bikes_moved"),
    )


def maintenance_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of compactions each day of the status rows, one row for each of five tables; one fails now and then."""
    days = status(spark, sf_dir).select(F.floor(F.col("snapshot_ts") / 86400).cast("long").alias("day")).distinct()
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.lower("r_name").alias("table_name"))
    rows = days.join(F.broadcast(r))
    bad = F.pmod(F.col("day") + F.col("k"), F.lit(11)) == 0
    return rows.select(F.concat(F.lit("run-"), F.col("day").cast("string")).alias("run_id"), "table_name", F.when(bad, "error").otherwise("ok").alias("status"), (F.col("day") * 86400 + 90000 + F.col("k") * 60).alias("finished_at"))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files of two tables by partition: of status one a day for every ten minutes with rows, of trips one a month for each day."""
    s = status(spark, sf_dir).select(F.lit("status").alias("table_name"), F.floor(F.col("snapshot_ts") / 86400).cast("long").cast("string").alias("partition"), F.floor(F.col("snapshot_ts") / 600).cast("long").cast("string").alias("file"))
    t = table(spark, sf_dir, "lineitem").select(F.lit("trips").alias("table_name"), F.date_format("l_shipdate", "yyyy-MM").alias("partition"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("file"))
    return s.unionByName(t).distinct()
