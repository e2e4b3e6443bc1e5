"""Feed snapshots: from envelopes with a list of stations to one message a station, rejects beside them;
and the raw archive, whose files are named by day, hour and epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions.exprs import local_date, local_epoch

#: What an envelope of the feed holds.
STATION = (
    "station_id string, num_bikes_available int, num_bikes_disabled int, num_docks_available int, num_docks_disabled int, num_ebikes_available int,"
    " is_installed int, is_renting int, is_returning int, last_reported bigint"
)
ENVELOPE = f"last_updated bigint, ttl int, version string, data struct<stations: array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in STATION.split(','))}>>>"
REQUIRED = ("station_id", "num_bikes_available", "num_docks_available", "is_installed", "is_renting", "is_returning", "last_reported")


def read_archive(spark: SparkSession, root: str, feed: str, days: list[str] | None = None) -> DataFrame:
    """Envelopes of a feed's archive (gzipped JSON below dt=YYYY-MM-DD/HH/): feed, last_updated, version,
    fetched_at, stations, and the partition column dt, on which only the named days are read."""
    base = f"{root.rstrip('/')}/{feed}"
    raw = spark.read.schema(T._parse_datatype_string(ENVELOPE)).option("basePath", base).option("recursiveFileLookup", "false").json(f"{base}/dt=*/*")
    kept = raw if days is None else raw.where(F.col("dt").cast("string").isin(*days))
    return kept.select(F.lit(feed).alias("feed"), "last_updated", "version", path_epoch(F.col("_metadata.file_path")).alias("path_epoch"), F.col("data.stations").alias("stations"), F.col("dt").cast("string").alias("dt"))


def snapshot_id(feed: Column, last_updated: Column) -> Column:
    return F.concat_ws(":", feed, last_updated.cast("string"))


def _broken(row: Column) -> Column:
    """Names of the rules that a station's row breaks: what it must have, and counts below zero."""
    missing = [F.when(row[c].isNull(), F.lit(f"{c} missing")) for c in REQUIRED]
    below = [F.when(row[c] < 0, F.lit(f"{c} negative")) for c in ("num_bikes_available", "num_docks_available")]
    return F.array_compact(F.array(*missing, *below))


def _rows(envelopes: DataFrame) -> DataFrame:
    sid = snapshot_id(F.col("feed"), F.col("last_updated"))
    return envelopes.select("feed", "last_updated", "version", "fetched_at", sid.alias("snapshot_id"), F.explode("stations").alias("s")).withColumn("errors", _broken(F.col("s")))


def messages(envelopes: DataFrame) -> DataFrame:
    """One row for each valid station of each snapshot, keyed by its id; flags of 0 and 1 as booleans."""
    good = _rows(envelopes).where(F.size("errors") == 0)
    fields = [f.name for f in envelopes.schema["stations"].dataType.elementType if f.name != "station_id"]
    typed = lambda c: F.col(f"s.{c}").cast("boolean").alias(c) if c.startswith("is_") else F.col(f"s.{c}")
    stamps = [F.col("last_updated").alias("feed_last_updated"), F.col("version").alias("feed_version"), F.round("fetched_at", 3).alias("fetched_at"), "snapshot_id"]
    return good.select(F.col("s.station_id").alias("key"), *(typed(c) for c in fields), *stamps)


def rejects(envelopes: DataFrame) -> DataFrame:
    """What is not published: key, snapshot_id, errors, payload (JSON); an envelope without a list is one reject."""
    bad = _rows(envelopes).where(F.size("errors") > 0)
    rows = bad.select(F.coalesce("s.station_id", "snapshot_id").alias("key"), "snapshot_id", F.array_join("errors", "; ").alias("errors"), F.to_json("s").alias("payload"))
    sid = snapshot_id(F.col("feed"), F.col("last_updated"))
    whole = envelopes.where(F.col("stations").isNull()).select(sid.alias("key"), sid.alias("snapshot_id"), F.lit("stations missing").alias("errors"), F.lit(None).cast("string").alias("payload"))
    return rows.unionByName(whole)


def counts(envelopes: DataFrame) -> DataFrame:
    """Messages and rejects of each snapshot."""
    n = F.coalesce(F.size("stations"), F.lit(0))
    good = F.coalesce(F.size(F.filter("stations", lambda s: F.size(_broken(s)) == 0)), F.lit(0))
    sid = snapshot_id(F.col("feed"), F.col("last_updated"))
    return envelopes.select(sid.alias("snapshot_id"), good.cast("long").alias("messages"), (n - good + F.col("stations").isNull().cast("int")).cast("long").alias("rejects"))


def content(stations: Column) -> Column:
    """A hash of a list of stations, whatever its order."""
    return F.sha2(F.to_json(F.array_sort(stations)), 256)


def published(envelopes: DataFrame) -> DataFrame:
    """Snapshots that are worth publishing: (feed, last_updated, repeated, unchanged).

    repeated: fetched again with the same last_updated; unchanged: other time, same content as the one before."""
    by = Window.partitionBy("feed").orderBy("last_updated", "fetched_at")
    marked = envelopes.select("feed", "last_updated", "fetched_at", content(F.col("stations")).alias("content"))
    last = lambda c: F.lag(c).over(by)
    repeated = F.coalesce(F.col("last_updated") == last("last_updated"), F.lit(False))
    return marked.select("feed", "last_updated", "fetched_at", repeated.alias("repeated"), (~repeated & F.coalesce(F.col("content") == last("content"), F.lit(False))).alias("unchanged"))


def replayed(messages: DataFrame, day: int, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Messages of one UTC day's snapshots (day: days since 1970), of those number skip + 1 to skip + limit in order of time, as a
    replay sends them again: key, place of the snapshot, and a JSON value that says so. Refused if that leaves none."""
    if skip < 0 or (limit is not None and limit < 1):
        raise ValueError("skip must be 0 or more, and limit 1 or more")
    of_day = F.col("feed_last_updated").between(day * 86400, day * 86400 + 86399)
    messages = messages.where(of_day)
    times = messages.select("feed_last_updated").distinct()  # a day's snapshots, so not many
    n = times.count()
    if n <= skip:
        raise ValueError(f"{n} snapshots on day {day}, {skip} of them to be left out")
    if limit is not None:
        times = times.orderBy("feed_last_updated").limit(skip + limit)
    placed = times.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("feed_last_updated")).cast("long")).where(F.col("place") > skip)
    value = F.to_json(F.struct(*(c for c in messages.columns if c != "key"), F.lit(True).alias("replay")))
    return messages.join(F.broadcast(placed), "feed_last_updated").select("key", "place", value.alias("value"))


def path_epoch(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.json(?:\.gz)?$", 1).cast("long")


def listed(paths: DataFrame) -> DataFrame:
    """Archive paths with what their names say: feed, dt, epoch."""
    part = lambda p: F.regexp_extract("path", p, 1)
    return paths.select("path", part(r"raw/gbfs/([^/]+)/").alias("feed"), F.to_date(part(r"/dt=([0-9-]{10})/")).alias("dt"), path_epoch(F.col("path")).alias("epoch"))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """[start, end) of a Pacific day in epoch seconds: 23, 24 or 25 hours."""
    midnight = lambda d: local_epoch(d.cast("timestamp_ntz"))
    return midnight(day), midnight(F.date_add(day, 1))


def local_days(listing: DataFrame, feed: str) -> DataFrame:
    """Pacific days that a feed's archive reaches into: files, first and last epoch, hours of the day."""
    own = listing.where(F.col("feed") == feed).withColumn("day", local_date(F.col("epoch")))
    start, end = day_bounds(F.col("day"))
    return own.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.min("epoch").alias("first"), F.max("epoch").alias("last")).withColumn("day_hours", ((end - start) / 3600).cast("long"))


def complete_day(days: DataFrame, today: str) -> DataFrame:
    """One row: the newest day before ``today`` with files, else today if it has some, else null."""
    now = F.lit(today).cast("date")
    past = F.max(F.when(F.col("day") < now, F.col("day")))
    return days.agg(F.coalesce(past, F.max(F.when(F.col("day") == now, F.col("day")))).alias("day"))


def of_local_day(listing: DataFrame, feed: str, day: DataFrame, step_s: int = 900) -> DataFrame:
    """The last file in each ``step_s`` seconds of a Pacific day (one row: day): only the two UTC partitions
    that the day touches are looked at, and within them its bounds."""
    start, end = day_bounds(F.col("day"))
    bounds = day.select("day", start.alias("start"), end.alias("end"))
    near = listing.where(F.col("feed") == feed).join(F.broadcast(bounds), (F.col("dt") >= F.col("day")) & (F.col("dt") <= F.date_add("day", 1)))
    inside = near.where((F.col("epoch") >= F.col("start")) & (F.col("epoch") < F.col("end")))
    bucket = F.floor((F.col("epoch") - F.col("start")) / step_s).cast("long")
    return inside.groupBy(bucket.alias("bucket")).agg(F.max("epoch").alias("epoch"), F.max_by("path", "epoch").alias("path"))


def newest_before(listing: DataFrame, feed: str, days: DataFrame) -> DataFrame:
    """For each day: the newest file of a feed before the day's end, of the day itself or of an earlier one."""
    own = listing.where(F.col("feed") == feed).withColumn("day", local_date(F.col("epoch")))
    of_day = own.groupBy("day").agg(F.max_by("path", "epoch").alias("path"))
    # one row for each day of the archive
    known = days.select("day").distinct().join(of_day, "day", "left")
    run = Window.partitionBy().orderBy("day")
    return known.select("day", F.last("path", ignorenulls=True).over(run).alias("path"))

