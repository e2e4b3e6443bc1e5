"""Tumbling availability windows, and the staging of them by Pacific day and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.exprs import local_date, local_hour

WINDOW_S = 300
#: States whose share of a window is kept.
SHARES = ("empty", "full", "offline")


def windows(status: DataFrame, size_s: int = WINDOW_S) -> DataFrame:
    """One row for each station and window: samples, bikes, docks and the share of samples in each state."""
    begin = F.col("snapshot_ts") - F.pmod("snapshot_ts", F.lit(size_s))
    per_state = [F.count_if(F.col("state") == s).alias(f"n_{s}") for s in SHARES]
    counted = status.groupBy("station_id", begin.alias("window_start")).agg(*measures(), *per_state)
    return counted.withColumns({"window_end": F.col("window_start") + size_s, **shares()}).drop(*(f"n_{s}" for s in SHARES))


def measures() -> list[Column]:
    """What a window tells besides its shares."""
    return [F.count(F.lit(1)).alias("samples"), F.min("bikes").alias("min_bikes"), F.avg("bikes").alias("avg_bikes"), F.max("bikes").alias("max_bikes"), F.avg("docks").alias("avg_docks"), F.max("capacity").alias("capacity")]


def shares() -> dict[str, Column]:
    """share_<state> from n_<state> and samples."""
    return {f"share_{s}": F.col(f"n_{s}") / F.col("samples") for s in SHARES}


def staged(availability: DataFrame) -> DataFrame:
    known = availability.where(F.col("share_empty").isNotNull() & F.col("share_full").isNotNull())
    return known.withColumns({"service_date": local_date(F.col("window_start")), "hour_of_day": local_hour(F.col("window_start"))})
