"""The site's documents as DataFrames: live list and counts, alerts, and the delta-encoded replay."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlake.functions.exprs import STATES, view, wall


def latest(status: DataFrame) -> DataFrame:
    """The newest row of each station; of several at one time, that of the highest event_id."""
    rest = [c for c in status.columns if c not in ("station_id", "snapshot_ts", "event_id")]
    top = status.groupBy("station_id").agg(F.max_by(F.struct("snapshot_ts", *rest), F.struct("snapshot_ts", "event_id")).alias("r"))
    return top.select("station_id", "r.*")


def live(status: DataFrame, stations: DataFrame) -> DataFrame:
    """The live list: latest states with names, in order of state and name; unknown stations stay."""
    joined = latest(status).join(stations.select("station_id", "station_name", "region_id", "lat", "lon", F.col("capacity").alias("known_capacity")), "station_id", "left")
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    named = joined.select(
        "station_id", F.coalesce("station_name", F.lit("Unknown station")).alias("name"), view(F.col("region_id"), F.col("lat"), F.col("lon")).alias("view"), "state",
        "bikes", "docks", F.coalesce(F.col("known_capacity").cast("long"), "capacity").alias("capacity"), "snapshot_ts", place.alias("place"),
    )
    return named.orderBy("place", "name", "station_id")


def live_counts(live_list: DataFrame) -> DataFrame:
    """Stations by view (and for all) and state, zero where there are none."""
    views = live_list.select("view").distinct().unionByName(live_list.limit(1).select(F.lit("all").alias("view")))
    grid = views.select("view", F.explode(F.array(*map(F.lit, STATES))).alias("state"))
    both = live_list.select(F.explode(F.array(F.col("view"), F.lit("all"))).alias("view"), "state")
    return grid.join(both.groupBy("view", "state").agg(F.count(F.lit(1)).alias("n")), ["view", "state"], "left").na.fill(0)


def alerts_folded(alerts: DataFrame) -> DataFrame:
    """One row for each alerted episode: when it was raised and, once it is, resolved, and for how long it went on."""
    at = lambda a: F.max(F.when(F.col("action") == a, F.col("ts")))
    folded = alerts.groupBy("episode_id", "station_id", "kind").agg(F.min("start_ts").alias("started"), at("raised").alias("raised"), at("resolved").alias("resolved"))
    return folded.withColumn("duration_s", F.col("resolved") - F.col("started"))


def frames(status: DataFrame, step_s: int = 3600) -> DataFrame:
    """The last row of each station within each frame of ``step_s`` seconds."""
    frame = F.floor(F.col("snapshot_ts") / step_s).cast("long")
    last = status.groupBy(frame.alias("frame"), "station_id").agg(F.max_by(F.struct("state", "bikes", "docks"), F.struct("snapshot_ts", "event_id")).alias("r"))
    return last.select("frame", "station_id", "r.*")


def deltas(status: DataFrame, step_s: int = 3600) -> DataFrame:
    """Only the frames in which a station differs from its frame before, with its index: busiest first."""
    by = Window.partitionBy("station_id").orderBy("frame")
    now = F.struct("state", "bikes", "docks")
    moved = frames(status, step_s).withColumn("changed", ~now.eqNullSafe(F.lag(now).over(by))).where("changed").drop("changed")
    counts = moved.groupBy("station_id").agg(F.count(F.lit(1)).alias("changes"))
    # one row for each station
    index = counts.withColumn("station_index", (F.row_number().over(Window.partitionBy().orderBy(F.desc("changes"), "station_id")) - 1).cast("long"))
    return moved.join(F.broadcast(index), "station_id")


def decode(moved: DataFrame, frame: int) -> DataFrame:
    """Every seen station as it stood at a frame."""
    seen = moved.where(F.col("frame") <= frame)
    return seen.groupBy("station_id").agg(F.max_by(F.struct("state", "bikes", "docks"), "frame").alias("r")).select("station_id", "r.*")


def encode(daily: DataFrame) -> DataFrame:
    """Daily mart with stations and dates as indexes."""
    s = daily.select("station_id").distinct().withColumn("s", (F.row_number().over(Window.partitionBy().orderBy("station_id")) - 1).cast("long"))
    d = daily.select("service_date").distinct().withColumn("d", (F.row_number().over(Window.partitionBy().orderBy("service_date")) - 1).cast("long"))
    return daily.join(F.broadcast(s), "station_id").join(F.broadcast(d), "service_date").select("s", "d", F.round("share_empty", 3).alias("e"), F.round("share_full", 3).alias("f"))


def document(rows: DataFrame, columns: list[str], order: list[str], meta: dict[str, str]) -> DataFrame:
    """One JSON text of all rows (a site's page of a few thousand), with its size in bytes."""
    line = F.struct(*order, F.to_json(F.array(*(F.col(c).cast("string") for c in columns))).alias("line"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), ",").alias("b"))
    head = ",".join(f'"{k}":"{v}"' for k, v in meta.items())
    text = F.concat(F.lit("{" + head + ("," if head else "") + '"columns":["' + '","'.join(columns) + '"],"rows":['), "b", F.lit("]}"))
    return body.select(text.alias("document"), F.octet_length(text).alias("bytes"))


def in_order(mart: DataFrame, order: list) -> DataFrame:
    """A mart's rows with their place in a document: a document has a bounded number of stations, dates and hours."""
    return mart.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def nested(parts: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list[str]]], head: dict[str, str | int], most_bytes: int) -> DataFrame:
    """One JSON text of nested parts: constants, one-row frames as objects, and frames as lists of objects in the order of some of their columns.
    A text over ``most_bytes`` fails the query. Lists are a document's: of as many rows as a page shows."""
    made = [d.agg(F.first(F.struct(*d.columns)).alias(name)) for name, d in parts.items()]
    for name, (d, order) in lists.items():
        rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*d.columns).alias("r"))))
        made.append(d.agg(F.transform(rows, lambda x: x["r"]).alias(name)))
    all_ = made[0]
    for one_row in made[1:]:
        all_ = all_.join(F.broadcast(one_row))
    text = all_.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in head.items()), *parts, *lists)).alias("document"))
    size = F.octet_length("document")
    fits = F.when(size <= most_bytes, F.col("document")).otherwise(F.raise_error(F.concat(size.cast("string"), F.lit(f" bytes, more than {most_bytes}"))).cast("string"))
    return text.select(fits.alias("document"), size.alias("bytes"))


def export(spark: SparkSession, folder: str, documents: dict[str, DataFrame], data_as_of: int, generated_at: int, most_bytes: int = 1_000_000) -> dict:
    """Writes site documents (one row each: document, bytes) and, last, their manifest; the manifest.

    No file is written if one of them is over its budget. If the data are no newer than the last manifest's,
    nothing is written and that manifest is given back."""
    fs = spark._jvm.org.apache.hadoop.fs
    path = lambda name: fs.Path(f"{folder.rstrip('/')}/{name}")
    store = path("manifest.json").getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path("manifest.json")):
        last = json.loads(spark.read.text(f"{folder.rstrip('/')}/manifest.json", wholetext=True).first()[0])
        if last["data_as_of"] >= data_as_of:
            return last
    made = {name: df.first() for name, df in documents.items()}
    over = [name for name, row in made.items() if row["bytes"] > most_bytes]
    if over:
        raise ValueError(f"over {most_bytes} bytes: {', '.join(sorted(over))}")
    manifest = {"data_as_of": data_as_of, "generated_at": generated_at, "documents": {name: row["bytes"] for name, row in sorted(made.items())}}
    for name, text in [*((f"{name}.json", row["document"]) for name, row in made.items()), ("manifest.json", json.dumps(manifest))]:
        out = store.create(path(name), True)
        out.write(bytearray(text.encode()))
        out.close()
    return manifest


def iso(seconds: Column) -> Column:
    """An epoch as ISO 8601 text in UTC, with Z."""
    return F.date_format(wall(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def alerts_lists(alerts: DataFrame, stations: DataFrame, kept: int = 20) -> DataFrame:
    """The alerts page: open alerts, the longest first, then the last ``kept`` resolved ones, the newest first; each
    with its station's name, code and view. ``place`` counts within each list (open, resolved).

    The lists are ranked among open alerts (a station has one at most) and among the newest resolved ones only."""
    folded = alerts_folded(alerts).withColumn("list", F.when(F.col("resolved").isNull(), "open").otherwise("resolved"))
    last = folded.where("list = 'resolved'").orderBy(F.desc("resolved"), "episode_id").limit(kept)
    some = folded.where("list = 'open'").unionByName(last)
    first = F.when(F.col("list") == "open", F.col("started")).otherwise(-F.col("resolved"))
    named = some.join(stations.select("station_id", "station_name", "short_name", "region_id", "lat", "lon"), "station_id", "left")
    place = F.row_number().over(Window.partitionBy("list").orderBy(first, "episode_id"))
    return named.select(
        "list", place.cast("long").alias("place"), "episode_id", "station_id", "kind", F.coalesce("station_name", F.lit("Unknown station")).alias("name"), F.col("short_name").alias("code"),
        view(F.col("region_id"), F.col("lat"), F.col("lon")).alias("view"), iso(F.col("started")).alias("started"), iso(F.col("raised")).alias("raised"), iso(F.col("resolved")).alias("resolved"), "duration_s",
    )


def live_totals(live_list: DataFrame) -> DataFrame:
    """One row for each view and for all: stations, bikes, those that need attention, and how recent it is."""
    both = live_list.withColumn("view", F.explode(F.array(F.col("view"), F.lit("all"))))
    return both.groupBy("view").agg(F.count(F.lit(1)).alias("stations"), F.sum("bikes").alias("bikes"), F.count_if(F.col("state") != "ok").alias("problems"), iso(F.max("snapshot_ts")).alias("data_as_of"))


def filtered(live_list: DataFrame, view: str | None = None, only_problems: bool = False) -> DataFrame:
    """The stations that a visitor asked for: of one view, or only those not in order."""
    kept = live_list if view is None else live_list.where(F.col("view") == view)
    return kept.where(F.col("state") != "ok") if only_problems else kept


def natural(text: Column, width: int = 12) -> Column:
    """A key that sorts text with its numbers by their value: digits are padded to ``width``."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def sorted_list(df: DataFrame, column: str, descending: bool = False, tie: str = "station_id", numeric: bool = False) -> DataFrame:
    """df in order of a column, nulls last in both directions, ties by ``tie``; text in natural order. Adds ``place``:
    for lists that a page shows, of a fleet's stations at most."""
    key = F.col(column) if numeric else natural(F.col(column))
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(order, natural(F.col(tie)))).cast("long"))


def replay_frames(moved: DataFrame, step_s: int = 3600) -> DataFrame:
    """The replay's frames: time, and one flat array of (station_index, state, bikes, docks) of all stations that
    changed, by index. A frame holds a fleet's stations at most."""
    state = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")) - 1
    one = F.struct("station_index", state.alias("s"), "bikes", "docks")
    rows = moved.groupBy("frame").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    flat = F.flatten(F.transform("rows", lambda r: F.array(r["station_index"], r["s"], r["bikes"], r["docks"]).cast("array<bigint>")))
    return rows.select("frame", iso(F.col("frame") * step_s).alias("t"), flat.alias("d"))


def unframed(frames: DataFrame, index: DataFrame, frame: int) -> DataFrame:
    """Every seen station as it stood at a frame, read back from the arrays; index: (station_index, station_id)."""
    seen = frames.where((F.col("frame") <= frame) & (F.size("d") > 0))
    rows = seen.select("frame", "d", F.explode(F.sequence(F.lit(0), (F.size("d") / 4).cast("int") - 1)).alias("i"))
    at = lambda k: F.get("d", (F.col("i") * 4 + k).cast("int"))
    each = rows.select("frame", at(0).alias("station_index"), F.struct(at(1).alias("s"), at(2).alias("bikes"), at(3).alias("docks")).alias("v"))
    last = each.groupBy("station_index").agg(F.max_by("v", "frame").alias("v"))
    state = F.get(F.array(*map(F.lit, STATES)), F.col("v.s").cast("int"))
    return last.join(index, "station_index").select("station_id", state.alias("state"), F.col("v.bikes").alias("bikes"), F.col("v.docks").alias("docks"))


def newest_dates(daily: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the newest service dates of the daily mart."""
    top = daily.agg(F.max("service_date").alias("newest"))
    return daily.join(F.broadcast(top), F.col("service_date") > F.date_sub("newest", days)).drop("newest")


def header(mart: DataFrame, constants: list[str]) -> DataFrame:
    """One row: the mart's constant columns, which a document holds once; a column that is not constant fails."""
    once = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) > 1, F.raise_error(F.lit(f"{c} is not constant"))).otherwise(F.first(F.col(c).cast("string")))
    return mart.agg(*(once(c).alias(c) for c in constants))


def literal(c: Column, kind: str) -> Column:
    """A value as documents hold it: dates and times in ISO form, fractions with three digits at most."""
    if kind == "date":
        return c.cast("string")
    return F.bround(c, 3) if kind == "double" else c


def packed(mart: DataFrame, constants: list[str]) -> DataFrame:
    """A mart as its document's rows: stations as indexes by their first use in order of id, dates as indexes, constants
    and names left out."""
    kinds = dict(mart.dtypes)
    s = mart.select("station_id").distinct().withColumn("station", (F.row_number().over(Window.partitionBy().orderBy("station_id")) - 1).cast("long"))
    out = mart.join(F.broadcast(s), "station_id")
    if "service_date" in kinds:
        d = mart.select("service_date").distinct().withColumn("day", (F.row_number().over(Window.partitionBy().orderBy("service_date")) - 1).cast("long"))
        out = out.join(F.broadcast(d), "service_date")
    left_out = {"station_id", "station_name", "region_id", "service_date", *constants}
    return out.select("station", *(["day"] if "service_date" in kinds else []), *(literal(F.col(c), kinds[c]).alias(c) for c in mart.columns if c not in left_out))


def mart_windows(daily: DataFrame, rebalancing: DataFrame, hourly: DataFrame) -> DataFrame:
    """(mart, n, first, last) for the manifest: what time each mart covers."""
    line = lambda d, name, a, b: d.agg(F.lit(name).alias("mart"), F.count(F.lit(1)).alias("n"), F.min(a).cast("string").alias("first"), F.max(b).cast("string").alias("last"))
    return line(daily, "daily", "service_date", "service_date").unionByName(line(rebalancing, "rebalancing", "window_first_day", "window_last_day")).unionByName(line(hourly, "hourly", "trip_first_month", "trip_last_month"))


def hour_label(hour: Column) -> Column:
    """An hour of the day as people say it: 11 AM–12 PM."""
    said = lambda h: F.concat((F.pmod(h + 11, F.lit(12)) + 1).cast("string"), F.when(F.pmod(h, F.lit(24)) < 12, " AM").otherwise(" PM"))
    return F.concat(said(hour), F.lit("–"), said(hour + 1))


def duration_text(seconds: Column) -> Column:
    """2 h 5 min, 45 min, or 30 s."""
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    minutes = F.floor(seconds / 60)
    long = F.concat(part(F.floor(minutes / 60), " h"), F.when(minutes % 60 > 0, F.concat(F.lit(" "), part(minutes % 60, " min"))).otherwise(F.lit("")))
    return F.when(seconds.isNull(), F.lit(None).cast("string")).when(seconds < 60, part(seconds, " s")).when(minutes < 60, part(minutes, " min")).otherwise(long)


def freshness_word(age_s: Column) -> Column:
    """What the site says of its data: live, delayed or paused."""
    return F.when(age_s < 120, "live").when(age_s <= 300, "delayed").otherwise("paused")
