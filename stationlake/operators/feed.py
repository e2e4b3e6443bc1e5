"""Feed rules: parsing, validation with reasons, repeats, stations and regions, slices of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.exprs import Thresholds, capacity, station_state

MESSAGE = (
    "station_id string, last_updated long, last_reported long, num_bikes_available long, num_docks_available long,"
    " num_bikes_disabled long, is_renting boolean, fetched_at long"
)


def parse(messages: DataFrame) -> DataFrame:
    """Bronze: the fields of each JSON message beside its partition, offset and times; malformed ones are null."""
    body = F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"})
    return messages.select("*", body.alias("v")).select("partition", "offset", "kafka_ts", "processed_ts", "event_id", "v.*")


def violations(parsed: DataFrame) -> DataFrame:
    """parsed with the names of the rules that each row breaks."""
    rules = {
        "no station": F.col("station_id").isNull(), "no snapshot": F.col("last_updated").isNull(), "negative bikes": F.col("num_bikes_available") < 0,
        "negative docks": F.col("num_docks_available") < 0,
    }
    return parsed.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))


def split_counts(parsed: DataFrame) -> DataFrame:
    """Good rows and rejects of each snapshot."""
    v = violations(parsed)
    return v.groupBy("last_updated").agg(F.count_if(F.size("errors") == 0).alias("good"), F.count_if(F.size("errors") > 0).alias("rejected"))


def reject_reasons(parsed: DataFrame) -> DataFrame:
    return violations(parsed).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The first row of each key; rows without a key are skipped."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r"))
    return kept.select(key, "r.*")


def latest_per_key(messages: DataFrame) -> DataFrame:
    """The newest message of each key of a keyed log, by time and offset."""
    top = messages.groupBy("key").agg(F.max_by(F.struct("value", "kafka_ts", "partition", "offset"), F.struct("kafka_ts", "partition", "offset")).alias("r"))
    return top.select("key", "r.*")


def slice_(status: DataFrame, skip: int, limit: int) -> DataFrame:
    """The rows of the snapshots number skip+1 to skip+limit, in order of time."""
    times = status.select("snapshot_ts").distinct().orderBy("snapshot_ts").limit(skip + limit)
    place = times.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("snapshot_ts")))
    return status.join(F.broadcast(place.where(F.col("place") > skip)), "snapshot_ts")


def unchanged(status: DataFrame) -> DataFrame:
    """Days of a station whose content is that of its day before, whatever the order of their rows: their number, and the sum
    of the leading 60 bits of each row's SHA-256, modulo 2**60. Both add up before the shuffle; no day meets in one row."""
    line = F.concat_ws(",", F.pmod("snapshot_ts", F.lit(86400)).cast("string"), F.col("bikes").cast("string"))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    day = F.floor(F.col("snapshot_ts") / 86400).cast("long")
    content = status.groupBy("station_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.sum(part) % F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias("content"))
    before = lambda c: F.lag(c).over(Window.partitionBy("station_id").orderBy("day"))
    same = (F.col("content") == before("content")) & (F.col("n") == before("n"))
    return content.withColumn("unchanged", F.coalesce(same, F.lit(False)))


#: The fields that a status message may have.
STATUS_FIELDS = (
    "station_id string, num_bikes_available int, num_bikes_disabled int, num_docks_available int, num_docks_disabled int, num_ebikes_available int,"
    " is_installed boolean, is_renting boolean, is_returning boolean, last_reported bigint, feed_last_updated bigint, feed_version string, fetched_at double,"
    " snapshot_id string, num_scooters_available int, num_scooters_unavailable int"
)
#: Columns that came later; a table has them last.
LATER = ("num_scooters_available", "num_scooters_unavailable")


def bronze(raw: DataFrame) -> DataFrame:
    """The status topic as it arrived: typed fields, the topic's own columns, the raw text, later fields last.

    Times are epoch seconds. Text that is no JSON gives nulls, and stays in raw_json."""
    stamps = {"last_reported": "last_reported_ts", "feed_last_updated": "snapshot_ts", "fetched_at": "fetched_ts"}
    read = raw.withColumn("v", F.from_json(F.col("value").cast("string"), STATUS_FIELDS))
    names = [x.split()[0] for x in STATUS_FIELDS.split(",")]
    first = [F.col(f"v.{n}").alias(stamps.get(n, n)) for n in names if n not in LATER]
    own = [F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts"), F.col("value").cast("string").alias("raw_json")]
    return read.select(*first, *own, *(F.col(f"v.{n}") for n in LATER))


def silver(rows: DataFrame, processed: Column, t: Thresholds = Thresholds(), keep: list[str] | None = None) -> DataFrame:
    """Bronze rows that have a station and a time, with capacity, state and when they were processed; what only
    bronze keeps is left out, but for the columns ``keep``."""
    bikes, docks = F.col("num_bikes_available"), F.col("num_docks_available")
    valid = rows.where(F.col("station_id").isNotNull() & F.col("snapshot_ts").isNotNull())
    sized = valid.withColumn("capacity", capacity(bikes, docks, F.col("num_bikes_disabled"), F.col("num_docks_disabled")))
    working, age = F.col("is_installed") & F.col("is_renting"), F.col("snapshot_ts") - F.col("last_reported_ts")
    state = station_state(bikes, docks, F.col("capacity"), working, age, t)
    return sized.select(
        "station_id", "snapshot_ts", "last_reported_ts", "num_bikes_available", "num_bikes_disabled", "num_ebikes_available", "num_docks_available", "num_docks_disabled", "capacity",
        "is_installed", "is_renting", "is_returning", state.alias("state"), "fetched_ts", "kafka_ts", processed.alias("processed_ts"), "num_scooters_available", *(keep or ()),
    )
