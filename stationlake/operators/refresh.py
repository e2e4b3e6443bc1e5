"""Marts kept up to date: when rows arrive, only the service dates that they touch are computed again.

silver (partitioned by service date) is what arrived; availability_parts has sums for each station, service date and hour, from which
both the daily mart (its own partitions) and the hourly profile are made, so that neither reads older rows again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions.exprs import clamp, local_date, r6
from stationlake.operators import availability
from stationlake.operators.tables import Lake

SILVER, PARTS, DAILY = "silver_by_date", "availability_parts", "mart_daily"


def parts(status: DataFrame) -> DataFrame:
    """Sums over the windows of each station, service date and hour; windows end with their hour, so no sum spans two."""
    staged = availability.staged(availability.windows(status))
    return staged.groupBy("service_date", "station_id", "hour_of_day").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("share_empty").alias("empty"), F.sum("share_full").alias("full"), F.sum("avg_bikes").alias("bikes"),
        F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"),
    )


def daily(sums: DataFrame, stations: DataFrame) -> DataFrame:
    """The daily mart from sums: one row for each current station and service date."""
    total = lambda c: F.sum(c)
    n = total("windows")
    a = sums.groupBy("station_id", "service_date").agg(
        n.alias("windows"), r6(n / 12.0).alias("coverage_hours"), r6(clamp(total("empty") / n)).alias("share_empty"), r6(clamp(total("full") / n)).alias("share_full"),
        r6(total("empty") * 5).alias("minutes_empty"), r6(total("full") * 5).alias("minutes_full"), r6(total("bikes") / n).alias("avg_bikes"),
        F.min("first_window").alias("first_window"), F.max("last_window").alias("last_window"),
    )
    return a.join(stations.select("station_id", "station_name", "region_id"), "station_id")


def profile(lake: Lake) -> DataFrame:
    """Mean shares of each station and hour of the day over all service dates, from the sums: a row for each hour and date at most."""
    n = F.sum("windows")
    return lake.read(PARTS).groupBy("station_id", "hour_of_day").agg(
        r6(clamp(F.sum("empty") / n)).alias("share_empty"), r6(clamp(F.sum("full") / n)).alias("share_full"), F.count_distinct("service_date").alias("live_days")
    )


def arrive(lake: Lake, rows: DataFrame, stations: DataFrame) -> tuple[list[dt.date], int]:
    """Rows that have arrived: kept, and the marts of their service dates made anew. The dates, and how many rows were read for them."""
    dated = rows.withColumn("service_date", local_date(F.col("snapshot_ts")))
    days = sorted(r[0] for r in dated.select("service_date").distinct().collect())
    if not days:
        return [], 0
    lake.append(SILVER, dated, ("service_date",))
    return days, recompute(lake, days, stations)


def recompute(lake: Lake, days: list[dt.date], stations: DataFrame) -> int:
    """The sums and the daily mart of some service dates from their rows alone; the number of rows read."""
    touched = F.col("service_date").isin(days)
    rows = lake.read(SILVER).where(touched)
    n = rows.count()
    lake.replace_where(PARTS, parts(rows), touched, ("service_date",))
    lake.replace_where(DAILY, daily(lake.read(PARTS).where(touched), stations), touched, ("service_date",))
    return n
