"""Rules over status rows and tables: one pass for all row rules, violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.exprs import STATES


def newest_day(status: DataFrame) -> DataFrame:
    """Rows of the newest 24 hours: (newest - 24 h, newest]."""
    top = status.agg(F.max("snapshot_ts").alias("newest"))
    return status.join(F.broadcast(top), F.col("snapshot_ts") > F.col("newest") - 86400)


def row_rules() -> dict[str, Column]:
    """What is wrong with a row, by rule."""
    return {
        "station_id not null": F.col("station_id").isNull(),
        "snapshot_ts not null": F.col("snapshot_ts").isNull(),
        "state domain": ~F.col("state").isin(*STATES),
        "bikes not negative": F.col("bikes") < 0,
        "docks not negative": F.col("docks") < 0,
        "bikes and docks within capacity": F.col("bikes") + F.col("docks") > F.col("capacity"),
    }


def expectations(status: DataFrame) -> DataFrame:
    """(rule, unexpected, elements, passed) for the newest day: row rules, row count and uniqueness in one scan each."""
    day = newest_day(status)
    rules = row_rules()
    counts = day.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())))
    pairs = F.array(F.struct(F.lit("row count").alias("rule"), (F.col("n") < 1).cast("long").alias("unexpected")), *(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("unexpected")) for i, name in enumerate(rules)))
    flat = counts.select("n", F.explode(pairs).alias("p")).select("p.rule", "p.unexpected", F.col("n").alias("elements"))
    keys = day.groupBy("station_id", "snapshot_ts").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("unexpected"), F.coalesce(F.sum("count"), F.lit(0)).alias("elements"))
    return flat.unionByName(keys.select(F.lit("unique station and snapshot").alias("rule"), "unexpected", "elements")).withColumn("passed", F.col("unexpected") == 0)


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys that the parent lacks, with their rows: counted before the join."""
    n = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def unaccepted(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def shares_out_of_range(daily: DataFrame, hourly: DataFrame) -> DataFrame:
    """Rows of either mart with a share outside [0, 1], and the marts' row counts."""
    bad = lambda d, name: d.agg(F.lit(name).alias("mart"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("share_empty").between(0, 1) | ~F.col("share_full").between(0, 1)).alias("bad"))
    return bad(daily, "daily").unionByName(bad(hourly, "hourly"))


def share_violations(marts: dict[str, DataFrame]) -> DataFrame:
    """The rows of marts with a share outside [0, 1], each with its mart's name."""
    bad = ~F.col("share_empty").between(0, 1) | ~F.col("share_full").between(0, 1)
    out = None
    for name, mart in sorted(marts.items()):
        rows = mart.where(bad).select(F.lit(name).alias("mart"), "station_id", "share_empty", "share_full")
        out = rows if out is None else out.unionByName(rows)
    return out


def offset_gaps(bronze: DataFrame) -> DataFrame:
    """Missing and repeated offsets of each partition."""
    return bronze.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), (F.max("offset") - F.min("offset") + 1 - F.count_distinct("offset")).alias("missing"), (F.count(F.lit(1)) - F.count_distinct("offset")).alias("repeated"))


def duplicates(status: DataFrame) -> DataFrame:
    return status.groupBy("station_id", "snapshot_ts").count().agg(F.sum("count").alias("n"), F.sum(F.col("count") - 1).alias("duplicates"))
