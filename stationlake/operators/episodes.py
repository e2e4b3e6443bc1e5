"""Episodes of a station in one problem state, as gaps and islands over its status rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.exprs import PACIFIC, PROBLEMS, Thresholds, episode_id, wall


def first_rows(status: DataFrame) -> DataFrame:
    """One row for each station and snapshot: the one that came first (of lowest event_id)."""
    kept = status.groupBy("station_id", "snapshot_ts").agg(F.min_by(F.struct("state", "bikes", "docks", "capacity"), "event_id").alias("r"))
    return kept.select("station_id", "snapshot_ts", "r.*")


def runs(status: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Runs of rows of one kind (empty, full, or null for neither) within a station's UTC day: when each begins and
    ends, its rows of the first ``alert_after_s`` seconds, and the first row after them. A hot station's history
    is thus dealt out by days; all that is done for a station as a whole is done on its runs."""
    by_time = Window.partitionBy("station_id", "day").orderBy("snapshot_ts")
    kind = F.when(F.col("state").isin(*PROBLEMS), F.col("state"))
    rows = first_rows(status).select("station_id", "snapshot_ts", kind.alias("kind"), F.floor(F.col("snapshot_ts") / 86400).alias("day"))
    turns = F.lag("snapshot_ts").over(by_time).isNull() | ~F.col("kind").eqNullSafe(F.lag("kind").over(by_time))
    rows = rows.withColumn("turn", F.when(turns, F.col("snapshot_ts"))).withColumn("begin", F.last("turn", ignorenulls=True).over(by_time))
    soon = F.col("snapshot_ts") < F.col("begin") + t.alert_after_s
    early = F.sort_array(F.collect_set(F.when(soon & F.col("kind").isNotNull(), F.col("snapshot_ts"))))
    return rows.groupBy("station_id", "day", "begin", "kind").agg(F.max("snapshot_ts").alias("last_ts"), early.alias("early"), F.min(F.when(~soon, F.col("snapshot_ts"))).alias("late"))


def islands(status: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """station_id, kind, start_ts, last_ts, end_ts (null while open) and raised_ts (null if it never got old enough)."""
    by_time = Window.partitionBy("station_id").orderBy("begin")
    of = runs(status, t)
    turns = F.lag("begin").over(by_time).isNull() | ~F.col("kind").eqNullSafe(F.lag("kind").over(by_time))
    marked = of.withColumn("turn", F.when(turns, F.col("begin"))).withColumn("start_ts", F.last("turn", ignorenulls=True).over(by_time)).withColumn("next", F.lead("begin").over(by_time))
    old = F.col("start_ts") + t.alert_after_s
    reached = F.coalesce(F.get(F.filter("early", lambda x: x >= old), F.lit(0)), F.col("late"))
    return marked.where(F.col("kind").isNotNull()).groupBy("station_id", "kind", "start_ts").agg(F.max("last_ts").alias("last_ts"), F.max_by("next", "begin").alias("end_ts"), F.min(reached).alias("raised_ts"))


def episodes(status: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """episode_id, station, kind, start, end (null while open), duration, status and alerted.

    An episode ends at the first row of another kind, offline included; an open one lasts to its newest row.
    It is alerted at its first row that is old enough."""
    return islands(status, t).select(
        episode_id(F.col("station_id"), F.col("kind"), F.col("start_ts")).alias("episode_id"), "station_id", "kind", "start_ts", "end_ts",
        (F.coalesce("end_ts", "last_ts") - F.col("start_ts")).alias("duration_s"), F.when(F.col("end_ts").isNull(), "open").otherwise("closed").alias("status"),
        F.col("raised_ts").isNotNull().alias("alerted"),
    )


def alerts(status: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each alert raised or resolved."""
    found = islands(status, t).where("raised_ts is not null")
    words = F.array(F.struct(F.lit("raised").alias("action"), F.col("raised_ts").alias("ts")), F.struct(F.lit("resolved").alias("action"), F.col("end_ts").alias("ts")))
    each = found.select(episode_id(F.col("station_id"), F.col("kind"), F.col("start_ts")).alias("episode_id"), "station_id", "kind", "start_ts", F.explode(words).alias("w")).where("w.ts is not null")
    return each.select(F.concat_ws(":", "episode_id", "w.action").alias("alert_id"), "episode_id", "station_id", "kind", "w.action", "start_ts", (F.col("w.ts") - F.col("start_ts")).alias("duration_s"), "w.ts")


#: What an alert of a kind is about.
SAID = {"empty": "no bikes", "full": "no free docks"}


def alert_texts(alerts: DataFrame, stations: DataFrame) -> DataFrame:
    """Subject (100 characters at most) and body of each alert, raised or resolved; minutes are rounded half to even, clocks are Pacific."""
    named = alerts.join(stations.select("station_id", "station_name"), "station_id", "left")
    name = F.coalesce("station_name", "station_id")
    what = F.element_at(F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair)), F.col("kind"))
    minutes = F.concat(F.bround(F.col("duration_s") / 60).cast("long").cast("string"), F.lit(" min"))
    clock = F.concat(F.date_format(wall(F.col("start_ts"), PACIFIC), "h:mm a"), F.lit(" Pacific"))
    raised = F.col("action") == "raised"
    subject = F.when(raised, F.concat(name, F.lit(": "), what, F.lit(" for "), minutes)).otherwise(F.concat(name, F.lit(": back in order")))
    body = F.when(raised, F.concat(F.lit("Since "), clock, F.lit(" there are "), what, F.lit(" at "), name, F.lit(": "), minutes, F.lit(" up to now.")))
    body = body.otherwise(F.concat(F.lit("What began at "), clock, F.lit(" at "), name, F.lit(" is over after "), minutes, F.lit(".")))
    return named.select("alert_id", F.substring(subject, 1, 100).alias("subject"), body.alias("body"))
