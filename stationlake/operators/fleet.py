"""Dispatch (jobs that are due, vans for them), month lists, trip mapping, and table layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.exprs import local_epoch


def unfinished(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs of each station."""
    return jobs.where(F.col("status").isin("open", "assigned")).groupBy("station_id").agg(F.count(F.lit(1)).alias("jobs"), F.min("opened_at").alias("oldest"))


HOUR = 3600


def _hours(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each hour that [start, end) touches: the hour's first second as ``hour``, and the part within as a and b."""
    hours = F.sequence(F.floor(F.col(start) / HOUR) * HOUR, F.floor((F.col(end) - 1) / HOUR) * HOUR, F.lit(HOUR).cast("long"))
    pieces = df.where(F.col(end) > F.col(start)).withColumn("hour", F.explode(hours))
    return pieces.withColumns({"a": F.greatest(start, "hour"), "b": F.least(F.col(end), F.col("hour") + HOUR)})


def due(episodes: DataFrame, jobs: DataFrame, handled: DataFrame | None = None, after_s: int = 1200, tick_s: int = 60) -> DataFrame:
    """Empty episodes that get a job, each with the tick that opens it: the first one, at least ``after_s`` after its start and before
    its end, at which no job is unfinished at its station. handled: episodes (episode_id) that have had one.

    Episodes and jobs are dealt to the hours they touch, so no window and no join is by station alone. Within an hour the jobs
    leave gaps; an episode's tick is the first one in a gap of any of its hours. A job that is not closed goes on to the end of the last episode."""
    long = episodes.where((F.col("kind") == "empty") & (F.col("duration_s") > after_s)).select("episode_id", "station_id", "start_ts", "duration_s")
    if handled is not None:
        long = long.join(handled.select("episode_id").distinct(), "episode_id", "left_anti")
    long = long.withColumns({"from": F.col("start_ts") + after_s, "to": F.col("start_ts") + F.col("duration_s")})
    last = F.broadcast(long.agg(F.max("to").alias("last")))
    busy = _hours(jobs.select("station_id", "opened_at", "closed_at").join(last).select("station_id", "opened_at", F.coalesce("closed_at", "last").alias("until")), "opened_at", "until")
    within = Window.partitionBy("station_id", "hour").orderBy("a", "b")
    # what earlier jobs of the hour leave before each, and what the last leaves of the hour
    before = F.coalesce(F.max("b").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("hour"))
    gaps = busy.select("station_id", "hour", before.alias("g0"), F.col("a").alias("g1"))
    rest = busy.groupBy("station_id", "hour").agg(F.max("b").alias("g0")).withColumn("g1", F.col("hour") + HOUR)
    gaps = gaps.unionByName(rest.select("station_id", "hour", "g0", "g1"))
    asked = _hours(long, "from", "to")
    met = asked.join(gaps, ["station_id", "hour"], "left").withColumns({"g0": F.coalesce("g0", "a"), "g1": F.coalesce("g1", "b")})
    tick = F.ceil(F.greatest("a", "g0") / tick_s) * tick_s
    first = met.where(tick < F.least("b", "g1")).groupBy("episode_id", "station_id", "start_ts", "duration_s").agg(F.min(tick).alias("due_at"))
    return first.select("episode_id", "station_id", "start_ts", "duration_s", F.col("due_at").cast("long").alias("due_at"))


def assign(jobs: DataFrame, vans: DataFrame) -> DataFrame:
    """Waiting jobs, the longest first, each with an idle van by plate, while there are vans.

    Jobs are numbered within the day they were opened on, days by what came before; vans are a fleet's, so one task numbers them."""
    waiting = jobs.where("status = 'open'").withColumn("day", F.floor(F.col("opened_at") / 86400))
    days = waiting.groupBy("day").agg(F.count(F.lit(1)).alias("jobs"))
    ahead = days.select("day", (F.sum("jobs").over(Window.orderBy("day")) - F.col("jobs")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("opened_at", "station_id", "job_id"))
    ranked = waiting.join(ahead, "day").withColumn("n", F.col("ahead") + place)
    idle = vans.where("status = 'idle'").withColumn("n", F.row_number().over(Window.orderBy("plate")).cast("long"))
    return ranked.join(idle.select("n", "van_id", "plate"), "n").select("job_id", "station_id", "opened_at", "van_id", "plate")


def month_status(trips: DataFrame) -> DataFrame:
    """Each month from the first to a month behind the last: published, missing or pending."""
    have = trips.groupBy("trip_month").agg(F.count(F.lit(1)).alias("trips"))
    ends = have.agg(F.min("trip_month").alias("a"), F.max("trip_month").alias("b"))
    months = ends.select("b", F.explode(F.expr("sequence(a, add_months(b, 1), interval 1 month)")).alias("trip_month"))
    status = F.when(F.col("trips").isNotNull(), "published").when(F.col("trip_month") < F.col("b"), "missing").otherwise("pending")
    return months.join(have, "trip_month", "left").select("trip_month", F.coalesce("trips", F.lit(0)).alias("trips"), status.alias("status"))


def mapped(raw: DataFrame) -> DataFrame:
    """Legacy trip texts (start_time, end_time, codes, user_type as text) as typed rows."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    at = lambda c: F.try_to_timestamp(text(c)).cast("timestamp_ntz")
    return raw.select(
        text("start_code").alias("start_code"), text("end_code").alias("end_code"), local_epoch(at("start_time")).alias("started"), local_epoch(at("end_time")).alias("ended"),
        F.expr("try_cast(trim(duration_sec) AS BIGINT)").alias("duration_s"), F.when(F.col("user_type") == "Subscriber", "member").when(F.col("user_type") == "Customer", "casual").alias("rider"),
    )


def raw_trips(trips: DataFrame) -> DataFrame:
    """Trips as the text that a legacy month file holds."""
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return trips.select(
        F.concat(F.lit(" "), "start_code").alias("start_code"), "end_code", clock("start_clock").alias("start_time"),
        clock(F.timestamp_add("SECOND", "duration_s", "start_clock")).alias("end_time"), F.col("duration_s").cast("string").alias("duration_sec"),
        F.when(F.col("rider") == "member", "Subscriber").otherwise("Customer").alias("user_type"),
    )


def checked(mapped_trips: DataFrame) -> DataFrame:
    """One row: rows, and those whose times can't be read, for which a month is refused."""
    return mapped_trips.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("started").isNull() | F.col("ended").isNull()).alias("bad"), F.count_if(F.col("start_code").isNull()).alias("no_code"), F.sum("duration_s").alias("seconds"))


def day_stats(status: DataFrame) -> DataFrame:
    """Rows and distinct hours of each UTC day."""
    return status.groupBy(F.floor(F.col("snapshot_ts") / 86400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.floor(F.col("snapshot_ts") / 3600)).alias("hours"))


def pick_days(stats: DataFrame, hours: int = 20, days: int = 2) -> DataFrame:
    """The newest days with so many hours; where there are too few, those with most rows."""
    full = (F.col("hours") >= hours).cast("int")
    enough = stats.agg((F.count_if(F.col("hours") >= hours) >= days).cast("int").alias("enough"))
    ranked = stats.join(F.broadcast(enough)).orderBy(F.desc(F.when(F.col("enough") == 1, full).otherwise(0)), F.desc(F.when(F.col("enough") == 1, F.col("day")).otherwise(F.col("n"))), F.desc("day"))
    return ranked.limit(days).select("day", "n", "hours")


def layout(files: DataFrame) -> DataFrame:
    """Partitions, files, rows and bytes of each layout (spec, partition, file, n, bytes)."""
    return files.groupBy("spec").agg(F.count_distinct("partition").alias("partitions"), F.count_distinct("file").alias("files"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def open_tickets(tickets: DataFrame) -> DataFrame:
    """Unfinished tickets of each dock (one at most, if the rules hold), and how long the oldest has been open for
    the newest opening of all: a scalar that each row is held against."""
    newest = tickets.agg(F.max("opened_at").alias("now"))
    of = tickets.where("status = 'open'").groupBy("station_id", "dock_no").agg(F.count(F.lit(1)).alias("tickets"), F.min_by("ticket_id", F.struct("opened_at", "ticket_id")).alias("oldest_ticket"), F.min("opened_at").alias("oldest"))
    return of.join(F.broadcast(newest)).withColumn("open_s", F.col("now") - F.col("oldest")).drop("now")


def docks(stations: DataFrame) -> DataFrame:
    """One row for each dock of each station: docks 1 to its capacity."""
    return stations.select("station_id", F.explode(F.sequence(F.lit(1), F.col("capacity"))).alias("dock_no")).withColumn("dock_id", F.concat_ws("-", "station_id", "dock_no"))


def busiest_partition(files: DataFrame) -> DataFrame:
    """Of each table (table_name, partition, file): the partition with most files, if it has more than one; in doubt
    the first by name. It is the one that is worth compacting."""
    n = files.groupBy("table_name", "partition").agg(F.count_distinct("file").alias("files")).where("files > 1")
    top = n.groupBy("table_name").agg(F.max("files").alias("files"))
    return n.join(top, ["table_name", "files"]).groupBy("table_name", "files").agg(F.min("partition").alias("partition"))
