"""Trip history: month files in two layouts as one typed table, with guards before a month is replaced."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.exprs import local_epoch

#: The columns of both layouts, and what riders are called.
LAYOUTS = {
    "ride": (
        "ride_id rideable_type started_at ended_at start_station_name start_station_id end_station_name end_station_id start_lat start_lng end_lat end_lng member_casual"
    ).split(),
    "legacy": (
        "duration_sec start_time end_time start_station_id start_station_name start_station_latitude start_station_longitude end_station_id end_station_name"
        " end_station_latitude end_station_longitude bike_id user_type"
    ).split(),
}
RIDERS = {"Subscriber": "member", "Customer": "casual"}
#: Where each layout has a column of the table; None: it has none.
SOURCE = {
    "ride_id": ("ride_id", None), "rideable_type": ("rideable_type", None), "start_station_code": ("start_station_id", "start_station_id"),
    "start_station_name": ("start_station_name", "start_station_name"), "end_station_code": ("end_station_id", "end_station_id"), "end_station_name": ("end_station_name", "end_station_name"),
    "bike_id": (None, "bike_id"),
}
PLACES = {
    "start_lat": ("start_lat", "start_station_latitude"), "start_lon": ("start_lng", "start_station_longitude"),
    "end_lat": ("end_lat", "end_station_latitude"), "end_lon": ("end_lng", "end_station_longitude"),
}


class TripError(ValueError):
    """A month that must not be loaded."""


def layout_of(header: Iterable[str]) -> str:
    """The layout whose columns the header has, in whatever order and with whatever others beside them. Names
    must be safe and different."""
    names = list(header)
    unsafe = [n for n in names if not n or any(not (c.isascii() and (c.islower() or c.isdigit() or c == "_")) for c in n)]
    if unsafe or not names:
        raise TripError(f"no header, or column names that are not safe: {unsafe}")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise TripError(f"columns that come twice: {twice}")
    lacks = {layout: sorted(set(columns) - set(names)) for layout, columns in LAYOUTS.items()}
    for layout, missing in lacks.items():
        if not missing:
            return layout
    raise TripError("no known layout; " + ", ".join(f"{layout} lacks {missing}" for layout, missing in lacks.items()))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A month's file or files as text columns: with a header row; a byte-order mark, quotes, line ends of both
    kinds, line breaks within quotes and blank lines are no matter. Splits files only where no quotes hold breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)


#: What is white space at the ends of a text.
BLANK = " \t\n\x0b\f\r"


def mapped(raw: DataFrame, layout: str | None = None) -> DataFrame:
    """Text columns of either layout as rows of the trips' table. Blank text is null, so is what can't be read;
    times are Pacific clock times, given as epoch seconds.

    In three steps, so that nothing is done twice: texts without their blanks, times read and converted, and their difference."""
    layout = layout or layout_of(raw.columns)
    at = list(LAYOUTS).index(layout)
    kept = [c for c in ("trip_month",) if c in raw.columns]
    clean = raw.select(*kept, *(F.nullif(F.trim(F.col(c), F.lit(BLANK)), F.lit("")).alias(c) for c in LAYOUTS[layout]))
    begin, end = ("started_at", "ended_at") if layout == "ride" else ("start_time", "end_time")
    clock = lambda c: local_epoch(F.col(c).try_cast("timestamp_ntz"))
    text = {name: F.lit(None).cast("string") if pair[at] is None else F.col(pair[at]) for name, pair in SOURCE.items()}
    places = {name: F.col(pair[at]).try_cast("double") for name, pair in PLACES.items()}
    known = F.create_map(*(F.lit(x) for pair in RIDERS.items() for x in pair))
    rider = F.lower("member_casual") if layout == "ride" else F.element_at(known, F.col("user_type"))
    seconds = F.lit(None).cast("bigint") if layout == "ride" else F.col("duration_sec").try_cast("bigint")
    named = {**text, **places, "started_at": clock(begin), "ended_at": clock(end), "duration_s": seconds, "member_type": rider}
    read = clean.select(*kept, F.lit(layout).alias("schema_version"), *(c.alias(n) for n, c in named.items()))
    return read.withColumn("duration_s", F.col("ended_at") - F.col("started_at")) if layout == "ride" else read


def checked(trips: DataFrame) -> DataFrame:
    """Of each month: rows, and those whose start or end can't be read; a month with such a row is refused."""
    bad = F.count_if(F.col("started_at").isNull() | F.col("ended_at").isNull())
    found = trips.groupBy("trip_month", "schema_version").agg(F.count(F.lit(1)).alias("csv_rows"), bad.alias("bad_timestamps"))
    return found.withColumn("status", F.when(F.col("bad_timestamps") == 0, "ok").otherwise("error"))


def load(trips: DataFrame, path: str) -> DataFrame:
    """Replaces the months that ``trips`` holds in a table partitioned by month, all or none, and counts them back;
    the audit rows: trip_month, schema_version, csv_rows, bad_timestamps, status, loaded_rows, error.

    Months that are refused are left as they were. One dynamic overwrite replaces the others: readers see their
    partitions change together, and no other partition is touched."""
    spark = trips.sparkSession
    verdicts = checked(trips)
    fine = trips.join(F.broadcast(verdicts.where("status = 'ok'").select("trip_month")), "trip_month", "left_semi")
    fine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trip_month").parquet(path)
    stored = spark.read.schema(fine.schema).parquet(path).groupBy("trip_month").agg(F.count(F.lit(1)).alias("stored"))
    audit = verdicts.join(stored, "trip_month", "left")
    good = F.col("status") == "ok"
    error = F.when(~good, F.concat(F.col("bad_timestamps").cast("string"), F.lit(" rows without a readable time"))).when(F.col("stored") != F.col("csv_rows"), F.lit("row count differs"))
    return audit.select("trip_month", "schema_version", "csv_rows", "bad_timestamps", F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.when(good, F.col("stored")).alias("loaded_rows"), error.alias("error"))


def month_start(text: Column) -> Column:
    """The first day of a month given as YYYY-MM; null if it is none."""
    return F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(text, F.lit("-01"))))


def month_files(names: DataFrame, name: str = "name") -> DataFrame:
    """Names of month files (YYYYMM-city-tripdata.csv.zip or .zip) with their month; other names are left out,
    and a month that comes more than once is ambiguous."""
    digits = F.regexp_extract(name, r"^(\d{6})-[a-z]+-tripdata(?:\.csv)?\.zip$", 1)
    month = month_start(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2)))
    found = names.where(digits != "").select(month.alias("trip_month"), F.col(name).alias("name")).where(F.col("trip_month").isNotNull())
    return found.groupBy("trip_month").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("files")).withColumn("ambiguous", F.col("files") > 1)


