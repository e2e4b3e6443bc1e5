"""Daily availability, rebalancing need, and trips against availability; and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.exprs import clamp, heat_bucket, local_date, local_hour, r6


def daily(staged: DataFrame, stations: DataFrame) -> DataFrame:
    """One row for each current station and Pacific day with live data."""
    a = staged.groupBy("station_id", "service_date").agg(
        F.count(F.lit(1)).alias("windows"), r6(F.count(F.lit(1)) / 12.0).alias("coverage_hours"), r6(clamp(F.avg("share_empty"))).alias("share_empty"),
        r6(clamp(F.avg("share_full"))).alias("share_full"), r6(F.sum("share_empty") * 5).alias("minutes_empty"), r6(F.sum("share_full") * 5).alias("minutes_full"),
        r6(F.avg("avg_bikes")).alias("avg_bikes"), F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"),
    )
    return a.join(stations.select("station_id", "station_name", "region_id"), "station_id")


def rebalancing(staged: DataFrame, episodes: DataFrame, stations: DataFrame, need_days: int = 7) -> DataFrame:
    """Hours empty and full of each station over the newest days, its episodes then, and the rank of its need."""
    live = staged.agg(F.max("service_date").alias("last_day"), F.max("window_end").alias("last_window")).withColumn("before", F.date_sub("last_day", need_days))
    recent = staged.join(F.broadcast(live.select("before")), F.col("service_date") > F.col("before"))
    hours = recent.groupBy("station_id").agg((F.sum("share_empty") * 5 / 60.0).alias("e"), (F.sum("share_full") * 5 / 60.0).alias("f"), (F.count(F.lit(1)) / 12.0).alias("c"))
    ended = episodes.join(F.broadcast(live), local_date(F.col("start_ts")) > F.col("before")).withColumn("end", F.coalesce("end_ts", "last_window"))
    ep = ended.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("alerted").alias("al"), (F.max(F.when(F.col("kind") == "empty", F.col("end") - F.col("start_ts"))) / 3600.0).alias("longest"))
    joined = hours.join(stations, "station_id").join(ep, "station_id", "left").join(F.broadcast(live.select("last_day", F.date_add("before", 1).alias("first_day"))))
    rank = F.rank().over(Window.orderBy(F.desc(r6(F.col("e") + F.col("f")))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "station_id", "station_name", "region_id", r6(F.col("e")).alias("hours_empty"), r6(F.col("f")).alias("hours_full"), rank.cast("long").alias("need_rank"), zero("n").cast("long").alias("episodes"),
        zero("al").cast("long").alias("alerted_episodes"), r6(F.coalesce("longest", F.lit(0.0))).alias("longest_empty_hours"), r6(F.col("c")).alias("coverage_hours"), F.col("first_day").alias("window_first_day"), F.col("last_day").alias("window_last_day"),
    )


def _newest(trips: DataFrame, months: int) -> DataFrame:
    return trips.select("trip_month").distinct().orderBy(F.desc("trip_month")).limit(months)


def newest_months(trips: DataFrame, months: int = 12) -> DataFrame:
    """Trips of the newest loaded months, with Pacific start and end hours."""
    return trips.join(F.broadcast(_newest(trips, months)), "trip_month", "left_semi").withColumns({"start_hour": local_hour(F.col("started")), "end_hour": local_hour(F.col("ended"))})


def trips_vs_availability(staged: DataFrame, trips: DataFrame, stations: DataFrame, months: int = 12) -> DataFrame:
    """Profile of each station by hour of day: trips a day against shares; hours without live data are absent."""
    t = newest_months(trips, months)
    ends = F.array(*(F.struct(F.col(c).alias("short_name"), F.col(h).alias("hour_of_day"), F.lit(i).alias("i")) for i, (c, h) in enumerate((("start_code", "start_hour"), ("end_code", "end_hour")))))
    # starts and ends are counted in one pass, by month, code and hour, before any station is looked up
    counts = t.select("trip_month", F.explode(ends).alias("e")).groupBy("trip_month", "e.short_name", "e.hour_of_day").agg(F.count_if(F.col("e.i") == 0).alias("s"), F.count_if(F.col("e.i") == 1).alias("e"))
    # by the months alone: trips are mapped and counted once
    covered = _newest(trips, months).agg(F.sum(F.dayofmonth(F.last_day("trip_month"))).alias("trip_days"), F.min("trip_month").alias("trip_first_month"), F.max("trip_month").alias("trip_last_month"))
    code = stations.select("station_id", "short_name")
    used = counts.join(code, "short_name").groupBy("station_id", "hour_of_day").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    avail = staged.groupBy("station_id", "hour_of_day").agg(r6(clamp(F.avg("share_empty"))).alias("share_empty"), r6(clamp(F.avg("share_full"))).alias("share_full"), F.count_distinct("service_date").alias("live_days"))
    keys = ["station_id", "hour_of_day"]
    joined = avail.join(stations.select("station_id", "station_name", "region_id"), "station_id").join(used, keys, "left").join(F.broadcast(covered))
    per_day = lambda c: r6(F.coalesce(c, F.lit(0)) / F.col("trip_days").cast("double"))
    return joined.select(
        "station_id", "station_name", "region_id", "hour_of_day", per_day("s").alias("trips_started_per_day"), per_day("e").alias("trips_ended_per_day"),
        "share_empty", "share_full", "live_days", "trip_days", "trip_first_month", "trip_last_month",
    )


def kpis(daily_mart: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: share of time empty and full, the worst hour and its share, trips a day."""
    time = daily_mart.agg(r6(F.sum("minutes_empty") / (F.sum("coverage_hours") * 60)).alias("time_empty"), r6(F.sum("minutes_full") / (F.sum("coverage_hours") * 60)).alias("time_full"))
    hours = profile.groupBy("hour_of_day").agg(r6(F.avg("share_empty")).alias("s"))
    worst = hours.agg(F.max_by(F.struct("hour_of_day", "s"), F.struct(F.col("s"), -F.col("hour_of_day"))).alias("w")).select(F.col("w.hour_of_day").alias("worst_hour"), F.col("w.s").alias("worst_share"))
    trips = profile.agg(F.round(F.sum("trips_started_per_day"), 3).alias("trips_per_day"))
    return time.join(F.broadcast(worst)).join(F.broadcast(trips))


def station_means(profile: DataFrame) -> DataFrame:
    """Mean share and trips a day of each station. The mean is taken in whole millionths, so that its last digit does
    not hang on the order in which shares are added."""
    n, total = F.count(F.lit(1)), F.sum(F.round(F.col("share_empty") * 1e6).cast("long"))
    return profile.groupBy("station_id", "station_name").agg((F.floor((2 * total + n) / (2 * n)) / 1e6).alias("mean_share"), r6(F.sum("trips_started_per_day")).alias("trips_per_day"))


def heatmap(profile: DataFrame, top: int = 25) -> DataFrame:
    """The stations with the largest mean share of empty time, with the colour of each."""
    return station_means(profile).orderBy(F.desc("mean_share"), "station_name").limit(top).withColumn("bucket", heat_bucket(F.col("mean_share")))


def quarters(profile: DataFrame) -> DataFrame:
    """Mean share of empty time of the busiest and of the quietest quarter of the stations."""
    m = station_means(profile)
    size = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 4), F.lit(1))
    # one row for each station: a fleet's worth, whatever the history's length
    placed = m.select("mean_share", size.alias("q"), F.row_number().over(Window.partitionBy().orderBy(F.desc("trips_per_day"), "station_id")).alias("busy"), F.row_number().over(Window.partitionBy().orderBy("trips_per_day", "station_id")).alias("quiet"))
    return placed.agg(r6(F.avg(F.when(F.col("busy") <= F.col("q"), F.col("mean_share")))).alias("busiest"), r6(F.avg(F.when(F.col("quiet") <= F.col("q"), F.col("mean_share")))).alias("quietest"))


def profiles(profile: DataFrame) -> DataFrame:
    """Twenty-four hourly shares of each station, null where there is no live data."""
    return profile.groupBy("station_id").pivot("hour_of_day", list(range(24))).agg(F.first("share_empty")).select("station_id", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24)))


def code_match(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Share of trips whose start code is a current station's."""
    n = trips.groupBy("start_code").agg(F.count(F.lit(1)).alias("n"))
    known = n.join(stations.select(F.col("short_name").alias("start_code"), F.lit(1).alias("known")), "start_code", "left")
    return known.agg(F.sum("n").alias("trips"), r6(F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("match_rate"))
